"""Fill-in-middle transformation by a parallel automaton scan.

Where a text may be cut is what a small automaton decides that reads bytes. A stretch of text, read from every state at once,
is a function: from the state before it to the state behind it and the units that begin in it. Such functions compose
associatively, so that blocks of a chunk, chunks of a text and texts of any size are scanned in parallel. A cut is then selected
from above: the chunk that holds the wanted unit, its block, and the byte. Short texts are one chunk, and a batch of them is
scanned together; chunks of giant texts are dealt over the cluster.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read_table, texts

#: Bytes of a chunk: longer texts are scanned in several tasks.
CHUNK = 1 << 16
#: Bytes of a block, and of the texts that are scanned together.
BLOCK, TOGETHER = 256, 1 << 22
SEED, CUT_PERCENT, SPM_PERCENT = 42, 50, 80
SENTINEL = "<[PSM]>"


@dataclass(frozen=True)
class Automaton:
    """``step`` and ``emit`` have, by class of the byte and state, the next state and whether a unit begins at the byte."""

    classes: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @property
    def states(self) -> int:
        return self.step.shape[1]

    @staticmethod
    def of_tokens() -> Automaton:
        """White space and then what is not, or white space at the end. States: nothing read, in white space, in a word.

        The last class is of no byte: it fills blocks and changes nothing.
        """
        classes = np.ones(256, np.uint8)
        classes[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
        step = np.array([[1, 1, 1], [2, 2, 2], [0, 1, 2]], np.uint8)
        return Automaton(classes, step, np.array([[1, 0, 1], [1, 0, 0], [0, 0, 0]], np.uint8))

    def blocks(self, bodies: list[bytes], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the bytes as (place in block, block), and the first block of each text and one past the last."""
        n = np.array([-(-len(b) // block) for b in bodies], np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        flat = np.full(int(first[-1]) * block, len(self.step) - 1, np.uint8)
        for body, at in zip(bodies, first):
            flat[at * block : at * block + len(body)] = self.classes[np.frombuffer(body, np.uint8)]
        return np.ascontiguousarray(flat.reshape(-1, block).T), first

    def functions(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit, count) by block and entry state."""
        n, s = classes.shape[1], self.states
        exits, counts = np.tile(np.arange(s, dtype=np.uint8), (n, 1)), np.zeros((n, s), np.int64)
        step, emit = self.step.ravel(), self.emit.ravel()
        few = np.zeros((n, s), np.uint16)
        for row in classes:
            at = row[:, None] * np.uint8(s) + exits
            few += emit[at]
            exits = step[at]
        return exits, counts + few

    def locate(self, classes: np.ndarray, entry: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """For each block the place at which its unit of that number begins, when it is entered in that state."""
        state, seen, out = entry.astype(np.uint8), np.zeros(len(entry), np.int64), np.full(len(entry), -1, np.int64)
        for place, row in enumerate(classes):
            begins = self.emit[row, state]
            out[(begins == 1) & (seen == unit)] = place
            seen += begins
            state = self.step[row, state]
        return out

    def compose(self, exits: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Functions of runs of pieces (those from first[i] to first[i + 1] - 1), and before each piece of its run.

        The k-th pieces of all runs are composed at once: (exit, count) of the runs, then of what lies before each piece.
        """
        s, n = self.states, np.diff(first)
        whole, total = np.tile(np.arange(s, dtype=np.uint8), (len(n), 1)), np.zeros((len(n), s), np.int64)
        before, passed = np.zeros_like(exits), np.zeros_like(counts)
        for k in range(int(n.max(initial=0))):
            runs = np.flatnonzero(n > k)
            piece = first[runs] + k
            before[piece], passed[piece] = whole[runs], total[runs]
            total[runs] += np.take_along_axis(counts[piece], whole[runs].astype(np.int64), 1)
            whole[runs] = np.take_along_axis(exits[piece], whole[runs].astype(np.int64), 1)
        return whole, total, before, passed

    def select(self, passed: np.ndarray, first: np.ndarray, run: np.ndarray, entry: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The piece of each run in which a unit begins: the last before which no more than ``unit`` units begin."""
        out = np.zeros(len(run), np.int64)
        for i, (r, e, u) in enumerate(zip(run, entry, unit)):
            out[i] = first[r] + np.searchsorted(passed[first[r] : first[r + 1], e], u, side="right") - 1
        return out


TOKENS = Automaton.of_tokens()


class Scan:
    """Some stretches of text, each entered in any state."""

    def __init__(self, bodies: list[bytes], automaton: Automaton = TOKENS, block: int = BLOCK):
        self.automaton, self.block = automaton, block
        self.classes, self.first = automaton.blocks(bodies, block)
        exits, counts = automaton.functions(self.classes)
        self.exits, self.counts, self.before, self.passed = automaton.compose(exits, counts, self.first)

    def places(self, which: np.ndarray, entry: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The byte at which a unit of a stretch begins, for each of ``which`` stretches."""
        blocks = self.automaton.select(self.passed, self.first, which, entry, unit)
        inside = self.automaton.locate(self.classes[:, blocks], self.before[blocks, entry], unit - self.passed[blocks, entry])
        return (blocks - self.first[which]) * self.block + inside


def drawn(seed: int, doc_id: object) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


@dataclass(frozen=True)
class Rule:
    seed: int = SEED
    cut_percent: int = CUT_PERCENT
    spm_percent: int = SPM_PERCENT

    def cuts(self, doc_id: object, n: int) -> tuple[int, int]:
        """How many of the n units lie before the middle, and before the suffix."""
        h = drawn(self.seed, doc_id)
        a, b = h[0] % (n + 1), h[1] % (n + 1)
        return min(a, b), max(a, b)

    def form(self, doc_id: object, body: bytes) -> str:
        h = drawn(self.seed, doc_id)
        if not body or re.search(SENTINEL.encode(), body) or h[2] % 100 >= self.cut_percent:
            return "plain"
        return "spm" if h[3] % 100 < self.spm_percent else "psm"

    def written(self, doc_id: object, body: bytes, start: int, end: int) -> tuple[str, int | None, int | None, bytes]:
        """(form, code points of prefix and middle, output) of a text whose middle lies between two bytes."""
        form = self.form(doc_id, body)
        if form == "plain":
            return form, None, None, body
        prefix, middle, suffix = body[:start], body[start:end], body[end:]
        out = [b"<P>", prefix, b"<S>", suffix, b"<M>", middle] if form == "psm" else [b"<S>", suffix, b"<P>", prefix, b"<M>", middle]
        return form, points(prefix), points(middle), b"".join(out)


def points(body: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero(np.frombuffer(body, np.uint8) & 0xC0 != 0x80))


def batched(rows: list, size) -> list[list]:
    """Rows in lists of about ``TOGETHER`` bytes."""
    out, held = [[]], 0
    for r in rows:
        if held > TOGETHER:
            out.append([])
            held = 0
        out[-1].append(r)
        held += size(r)
    return out


def _columns(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    names, kinds = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"), (id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], list(names))


def _short(rows: DataFrame, rule: Rule, schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = list(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()))
            for some in batched(rows, lambda r: len(r[1])):
                scan = Scan([body for _, body in some])
                n = scan.counts[:, 0]
                cuts = [rule.cuts(d, int(k)) for (d, _), k in zip(some, n)]
                ends = np.array([[len(body)] * 2 for _, body in some], np.int64).reshape(len(some), 2)
                wanted = np.array(cuts, np.int64).reshape(len(some), 2)
                which, side = np.nonzero(wanted < n[:, None])
                ends[which, side] = scan.places(which, np.zeros(len(which), np.int64), wanted[which, side])
                out = [(d, int(k), *rule.written(d, body, int(s), int(e))) for (d, body), k, (s, e) in zip(some, n, ends)]
                yield _columns(out, b.schema.field("doc_id").type)

    return rows.select("doc_id", "text").mapInArrow(run, schema)


def _summaries(giants: DataFrame, chunk: int) -> DataFrame:
    """(row, chunk, exits, counts) of every chunk of every giant text; chunks are dealt over the cluster."""
    n = F.ceil(F.octet_length("text") / F.lit(chunk)).cast("int")
    at = giants.select("row", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    pieces = at.select("row", "chunk", F.substring(F.col("text"), F.col("chunk") * chunk + 1, F.lit(chunk)).alias("text"))

    def run(batches):
        for b in batches:
            rows = list(zip(b.column("row").to_pylist(), b.column("chunk").to_pylist(), b.column("text").to_pylist()))
            for some in batched(rows, lambda r: len(r[2])):
                scan = Scan([r[2] for r in some])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int32()), pa.array(scan.exits.astype(int).tolist(), pa.list_(pa.int32())), pa.array(scan.counts.tolist(), pa.list_(pa.int64()))], ["row", "chunk", "exits", "counts"])

    return pieces.repartition("row", "chunk").mapInArrow(run, "row long, chunk int, exits array<int>, counts array<long>")


def _selected(summaries: DataFrame, doc_type: str, rule: Rule) -> DataFrame:
    """(row, n, and for both cuts: chunk, state in which it is entered, unit in it) of every giant text.

    A text's summaries meet in one task. They are few: a text that fits a row has at most 2^31 / ``CHUNK`` chunks.
    """

    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by("chunk")
        exits, counts = np.array(found["exits"].to_pylist(), np.uint8), np.array(found["counts"].to_pylist(), np.int64)
        first = np.array([0, len(exits)])
        _, total, before, passed = TOKENS.compose(exits, counts, first)
        n, row = int(total[0, 0]), found["row"][0].as_py()
        out = {"row": [row], "n": [n]}
        for name, unit in zip("ab", rule.cuts(found["doc_id"][0].as_py(), n)):
            k = int(TOKENS.select(passed, first, np.array([0]), np.array([0]), np.array([unit]))[0]) if unit < n else -1
            out |= {f"{name}_chunk": [k], f"{name}_state": [int(before[k, 0]) if k >= 0 else 0], f"{name}_unit": [unit - int(passed[k, 0]) if k >= 0 else 0]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return summaries.groupBy("row").applyInArrow(run, "row long, n long, a_chunk long, a_state long, a_unit long, b_chunk long, b_state long, b_unit long")


def _giant(giants: DataFrame, selected: DataFrame, rule: Rule, chunk: int, schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                body, ends = r["text"], []
                for cut in "ab":
                    k = r[f"{cut}_chunk"]
                    if k < 0:
                        ends.append(len(body))
                    else:
                        scan = Scan([body[k * chunk : (k + 1) * chunk]])
                        ends.append(k * chunk + int(scan.places(np.array([0]), np.array([r[f"{cut}_state"]]), np.array([r[f"{cut}_unit"]]))[0]))
                yield _columns([(r["doc_id"], r["n"], *rule.written(r["doc_id"], body, *ends))], b.schema.field("doc_id").type)

    return giants.join(selected, "row").mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    n counts the units, white space and what follows it. The rule draws from seed and doc_id two places between units, and
    whether the text is written in parts: ``psm`` prefix, suffix, middle, or ``spm`` suffix, prefix, middle, each behind its mark.
    ``plain`` texts stay as they are: empty and null ones (n is 0 and the output empty), those that contain a mark, and those
    not drawn. A null doc_id draws as the empty string. Rows that repeat a doc_id are cut each in its own text. Texts longer
    than ``chunk`` bytes are scanned in chunks in several tasks. Columns other than doc_id and text are passed over, whatever
    their names. An empty table gives an empty result.
    """
    rows = texts(docs, binary=True).select("doc_id", F.coalesce("text", F.lit("").cast("binary")).alias("text"))
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, n long, form string, prefix_chars long, middle_chars long, output binary"
    ws, size = Workspace(docs.sparkSession), F.octet_length("text")
    giants = ws.save(rows.where(size > chunk).withColumn("row", F.monotonically_increasing_id()), "giants")
    found = ws.save(_summaries(giants, chunk), "chunks").join(giants.select("row", "doc_id"), "row")
    cut = _giant(giants, _selected(found, doc_type, rule), rule, chunk, schema)
    out = _short(rows.where(size <= chunk), rule, schema).unionByName(cut)
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was written from."""
    part = F.split(output, SENTINEL, -1)
    psm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))
    spm = F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read_table(spark, sf_dir, "documents"))
    digest = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


OP12_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
n AS (
  SELECT doc_id, x, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM t),
p AS (
  SELECT doc_id, x, n, array_to_string(u[1 : least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1 : greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1 :], '') AS suffix,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= {CUT_PERCENT} THEN 'plain'
              WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM n)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN x ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
