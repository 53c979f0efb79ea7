"""Removal of repeated byte strings by anchored fingerprints at growing lengths.

They stand in for prefix doubling, which is beside them (``doubled_ranks``) and costs too much to shuffle. The positions of equal
strings are found by ranks of growing strings, as in the doubling construction of a suffix array; a position leaves as soon as its rank is unique, and equal ranks at the full length are repeats. Ranks are 64-bit fingerprints,
so that a rank needs no global numbering. Three things keep the rows few without losing a position:

* The first ranks (48 bytes) are taken at content-chosen positions only: the leftmost smallest fingerprint, the anchor, of
  each 100-byte window. Equal windows have equal anchors at equal places, so a window whose anchor is unique is done.
* A row stands for a run of neighbouring windows with one anchor, with a second rank of all the bytes under the run. Rows
  equal in that rank are repeats as a whole; only the first of them goes on, and only if its anchor has other rows too.
* These are ranked again at 88 bytes (runs of up to 13 windows), and what is still open at 100 bytes, window by window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ranked, read_table, row_key

LENGTH, FIRST, STEP = 100, 48, 13
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_PLACE_BITS = 26
_powers: dict[int, np.ndarray] = {}
PLACE = ["d", "sub", "j"]


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype=np.uint64)
    return _powers[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """Of every window of ``width`` values, the place of its leftmost smallest one by the leading bits.

    Value and place share a word, so that one running minimum finds both. Places have _PLACE_BITS whatever the text's length,
    so that equal windows are judged alike in texts of any length; a text too long for them is done in overlapping parts.
    """
    most = 1 << _PLACE_BITS
    if len(x) > most:
        step = most - width + 1
        return np.concatenate([leftmost_least(x[i : i + most], width).astype(np.int64) + i for i in range(0, len(x) - width + 1, step)])
    low = np.uint64(most - 1)
    least, k = (x & ~low) | np.arange(len(x), dtype=np.uint64), 1
    while k < width:
        step = min(k, width - k)
        least = np.minimum(least[:-step], least[step:])
        k += step
    return (least & low).astype(np.int64)


def runs(text: bytes, length: int = LENGTH, first: int = FIRST) -> tuple[np.ndarray, ...]:
    """key, whole, j, len, at of every run of windows with one anchor: j is the first window, at the anchor's place in it."""
    n = len(text)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32))
    with np.errstate(over="ignore"):
        inverse = _power(pow(_BASE, -1, 1 << 64), n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[np.frombuffer(text, dtype=np.uint8)] * _power(_BASE, n), out=sums[1:])
        grams = _mixed((sums[first:] - sums[:-first]) * inverse[: n - first + 1])
        anchor = leftmost_least(grams, length - first + 1)
        j = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(j, len(anchor)))
        whole = _mixed((sums[j + size + length - 1] - sums[j]) * inverse[j] + size.astype(np.uint64) * _MIX)
    return grams[anchor[j]].view(np.int64), whole.view(np.int64), j.astype(np.int32), size.astype(np.int32), (anchor[j] - j).astype(np.int32)


def _rank(b: bytes) -> int:
    h = xxhash.xxh64_intdigest(b)
    return h - (1 << 64) if h >> 63 else h


def parts(body: bytes, j: int, size: int, at: int, length: int = LENGTH, step: int = STEP) -> list[tuple]:
    """Divide a run into runs of up to ``step`` windows by the anchor's place in the window: (key, whole, j, len, body)."""
    out, w = [], 0
    while w < size:
        low = (at - w) // step * step  # the windows whose anchor is at low .. low + step - 1
        n = min(size, at - low + 1) - w
        key = body[at - low : at - low + length - step + 1]
        own = body[w : w + n + length - 1]
        out.append((_rank(b"%d %s" % (low, key)), _rank(own), j + w, n, own))
        w += n
    return out


def windows(body: bytes, j: int, size: int, length: int = LENGTH) -> list[tuple]:
    """Every window of a run: (key, whole, j, len)."""
    return [(r := _rank(body[w : w + length]), r, j + w, 1) for w in range(size)]


def resolve(ws: Workspace, rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Split rows of one rank into repeats and what is still open.

    A row with a unique key is neither. Of rows alike in ``whole`` all but the first are repeats. The first is open if its
    key has other rows with another ``whole``.
    """
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")).where("n > 1")
    stats = ws.save(stats.select("key", (F.col("a") != F.col("b")).alias("mixed")), f"{name}-ranks")
    # both small sides have one row a key: hashing them spares sorting the rows, and as tables they let a hot key's rows be split
    hit = ws.save(rows.join(stats.hint("shuffle_hash"), "key").drop("key"), f"{name}-hits")
    ws.drop(f"{name}-ranks")
    first = hit.groupBy("whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1").drop("n")
    first = ws.save(first, f"{name}-first")
    repeat = F.coalesce(F.struct(*PLACE) != F.col("first"), F.lit(False))
    found = hit.join(first.hint("shuffle_hash"), "whole", "left").withColumn("repeat", repeat).where("repeat or mixed")
    done = ws.save(found.drop("whole", "first", "mixed"), f"{name}-done")
    ws.drop(f"{name}-hits", f"{name}-first")
    return done.where("repeat").select(*PLACE, "len"), done.where("not repeat").drop("repeat")


def _table(schema: str, names: list[str]):
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return lambda columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def repeated_windows(ws: Workspace, rows: DataFrame) -> DataFrame:
    """(d, sub, j, len): runs of windows of ``rows`` (d, sub, text) that also start earlier. May repeat runs."""
    schema = "key bigint, whole bigint, d bigint, sub int, j int, len int, at int"
    names = [c.split()[0] for c in schema.split(", ")]

    def first_ranks(batches):
        for b in batches:
            found = [runs(t.as_py()) for t in b.column("text")]
            n = [len(f[0]) for f in found]
            key, whole, j, size, at = (np.concatenate(x) for x in zip(*found)) if found else runs(b"")
            d, sub = (np.repeat(b.column(c).to_numpy(), n) for c in ("d", "sub"))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (key, whole, d, sub, j, size, at))), names)

    repeats1, open1 = resolve(ws, rows.mapInArrow(first_ranks, schema), "rank1")

    wanted = open1.groupBy("d", "sub").agg(F.collect_set(F.struct("j", "len", "at")).alias("runs"))
    wanted = rows.join(wanted, ["d", "sub"]).dropDuplicates(["d", "sub"])
    schema2 = "key bigint, whole bigint, d bigint, sub int, j int, len int, body binary"

    def second_ranks(batches):
        pack = _table(schema2, [c.split()[0] for c in schema2.split(", ")])
        for b in batches:
            out = []
            for d, sub, text, own in zip(*(b.column(c).to_pylist() for c in ("d", "sub", "text", "runs"))):
                for r in own:
                    j, size = r["j"], r["len"]
                    out += [(key, whole, d, sub, *rest) for key, whole, *rest in parts(text[j : j + size + LENGTH - 1], j, size, r["at"])]
            yield pack(list(zip(*out)) or [[]] * 7)

    second = ws.save(wanted.mapInArrow(second_ranks, schema2), "parts")
    repeats2, open2 = resolve(ws, second, "rank2")
    schema3 = "key bigint, whole bigint, d bigint, sub int, j int, len int"

    def last_ranks(batches):
        pack = _table(schema3, [c.split()[0] for c in schema3.split(", ")])
        for b in batches:
            out = []
            for d, sub, j, size, body in zip(*(b.column(c).to_pylist() for c in ("d", "sub", "j", "len", "body"))):
                out += [(key, whole, d, sub, *rest) for key, whole, *rest in windows(body, j, size)]
            yield pack(list(zip(*out)) or [[]] * 6)

    third = ws.save(open2.select("d", "sub", "j", "len", "body").mapInArrow(last_ranks, schema3), "windows")
    ws.drop("parts")
    repeats3, _ = resolve(ws, third, "rank3")
    ws.drop("windows")
    return repeats1.unionByName(repeats2).unionByName(repeats3)


def cut_out(text: bytes, found: list[tuple[int, int]], length: int = LENGTH) -> tuple[int, int, str]:
    """n_removed, n_spans and the SHA-256 of what remains, for runs (j, len) of repeated windows."""
    spans: list[list[int]] = []
    for j, n in sorted(found):
        if spans and j <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], j + n + length - 1)
        else:
            spans.append([j, j + n + length - 1])
    left, at = hashlib.sha256(), 0
    for a, b in spans:
        left.update(text[at:a])
        at = b
    left.update(text[at:])
    return sum(b - a for a, b in spans), len(spans), left.hexdigest()


def numbered(ws: Workspace, rows: DataFrame) -> DataFrame:
    """(doc_id, d, text) with ``sub``: different texts of one d have different numbers, equal ones the same.

    Only rows whose d is not theirs alone are counted and joined; in a table of unique ids nothing but the ids is read.
    """
    many = ws.save(rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated-ids")
    if many.isEmpty():
        return rows.withColumn("sub", F.lit(0))
    keys = rows.join(many, "d", "left_semi").select("d", *row_key()).distinct()
    keys = ranked(keys, "d", [F.col("t1"), F.col("t2")], 64, ["t1", "t2"], "sub")
    keys = ws.save(keys.select(F.col("d").alias("d_"), F.col("t1").alias("t1_"), F.col("t2").alias("t2_"), F.col("sub").cast("int").alias("sub")), "numbers")
    own = dict(zip(("t1", "t2"), row_key()))
    both = rows.withColumns(own)
    out = both.join(keys, (both.d == keys.d_) & (both.t1 == keys.t1_) & (both.t2 == keys.t2_), "left")
    return out.select("doc_id", "d", "text", F.coalesce("sub", F.lit(0)).alias("sub"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A byte goes if a string of 100 bytes over it also starts earlier: at a smaller doc_id, or earlier in the same document.
    A null text counts as empty, a null doc_id as the smallest. Rows alike in doc_id and text are one document, each with its
    result; rows of one doc_id with different texts are ordered by a hash of the text. A text of any length is treated whole, and other
    columns are passed over, whatever their names. An empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession)
    body = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), body.alias("text"))
    rows = numbered(ws, rows)
    found = repeated_windows(ws, rows.select("d", "sub", "text"))
    found = found.groupBy("d", "sub").agg(F.collect_set(F.struct("j", "len")).alias("found"))

    def finish(batches):
        for b in batches:
            out = [cut_out(t, [(r["j"], r["len"]) for r in f or ()]) for t, f in zip(b.column("text").to_pylist(), b.column("found").to_pylist())]
            size = [len(t.as_py()) for t in b.column("text")]
            removed, spans, left = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = rows.join(found, ["d", "sub"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def doubled_ranks(ws: Workspace, docs: DataFrame, length: int = LENGTH, first: int = 7) -> DataFrame:
    """(doc_id, j, head_id, head_j): by prefix doubling as such, each position whose ``length`` bytes also start earlier.

    Ranks of ``first`` bytes are the bytes themselves; then the ranks at a position and behind it are sorted as pairs and ranked
    anew, at growing offsets, the last of which overlaps. A position leaves when its rank is unique. Every position that is left
    is a row of each round, so that this is for tables that fit several times into the shuffle: see the README for its figures.
    doc_ids are unique here.
    """
    body = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))

    def start(batches):
        for b in batches:
            d, j, r = [], [], []
            for i, t in zip(b.column("d").to_pylist(), b.column("text").to_pylist()):
                n = len(t) - first + 1
                if n > 0:
                    x = np.frombuffer(t, dtype=np.uint8).astype(np.int64)
                    r.append(sum(x[k : k + n] << np.int64(8 * (first - 1 - k)) for k in range(first)))
                    j.append(np.arange(n, dtype=np.int64))
                    d.append(np.full(n, i, dtype=np.int64))
            none = np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else none) for x in (d, j, r)], ["d", "j", "r"])

    rows = docs.select(F.col("doc_id").cast("long").alias("d"), body.alias("text")).mapInArrow(start, "d long, j long, r long")
    rows, k, step = ws.save(rows, "ranks-0"), first, 0
    while k < length:
        shift, step = min(k, length - k), step + 1
        behind = rows.select("d", (F.col("j") - shift).alias("j"), F.col("r").alias("s"))
        pairs = ws.save(rows.join(behind, ["d", "j"]), f"pairs-{step}")
        groups = pairs.groupBy("r", "s").agg(F.count(F.lit(1)).alias("n"), F.xxhash64("r", "s").alias("rank"))
        again = pairs.join(groups, ["r", "s"])
        k += shift
        # a position that is unique now still serves as what stands behind others: it is dropped only when no offset needs it
        rows = ws.save(again.select("d", "j", F.col("rank").alias("r"), "n"), f"ranks-{step}")
        if k < length:
            open_ = rows.where("n > 1").select("d", F.explode(F.array("j", F.col("j") + min(k, length - k))).alias("j")).distinct()
            rows = ws.save(rows.join(open_, ["d", "j"], "left_semi").drop("n"), f"open-{step}")
        ws.drop(f"pairs-{step}", f"ranks-{step - 1}")
    same = rows.where("n > 1")
    heads = same.groupBy("r").agg(F.min(F.struct("d", "j")).alias("h"))
    found = same.join(heads, "r").where((F.col("d") != F.col("h.d")) | (F.col("j") != F.col("h.j")))
    return found.select(F.col("d").alias("doc_id"), "j", F.col("h.d").alias("head_id"), F.col("h.j").alias("head_j"))


def op10_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
