"""Secret scans: fixed forms, and a battery of randomness tests for what has no form.

Long tokens are tested in the alphabet that they seem to be written in: a chi-squared test of uniform symbols, a runs test
about the middle of the alphabet and the serial correlation of neighbours, joined by Fisher's method. How random plain prose
can look at each length is measured over all texts on tokens made of their own letters; it turns the joined value into a
chance of a false discovery, and the rule of Benjamini and Hochberg picks the cut for each length. Short tokens, on which the
tests have no power, so need far more than long ones.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, free_name, read_table, row_key, texts

KINDS = ("assign", "access", "hex")
EXTRA = "random"
FALSE_DISCOVERY = 0.01
#: Least lengths of the classes in which tokens are compared.
LENGTHS = (20, 26, 34, 48, 72, 112)
#: The joined p value has this many bins; only counts of (length class, bin) reach the driver.
BINS = 200
SPAN = "kind string, start int, end int"
_hint = ("password", "passwd", "secret", "token", "apikey", "api_key")
_assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_access = re.compile(r"AKIA[A-Z0-9]{14,}")
_hex = re.compile(r"[0-9a-f]{16,}")
_token = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}")
_not_letters = bytes(b for b in range(256) if not chr(b).isascii() or not chr(b).isalpha())
#: So many windows of letters are tested at once.
WINDOWS = 1 << 13
_ALPHABETS = tuple(
    (re.compile(pattern), {c: i for i, c in enumerate(symbols)})
    for pattern, symbols in (
        (r"[0-9]+", "0123456789"),
        (r"[0-9a-f]+", "0123456789abcdef"),
        (r"[0-9A-F]+", "0123456789ABCDEF"),
        (r"[a-z]+", "abcdefghijklmnopqrstuvwxyz"),
        (r"[A-Z]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        (r"[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
        (r"[a-z0-9]+", "abcdefghijklmnopqrstuvwxyz0123456789"),
        (r"[A-Za-z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
        (r"[A-Za-z0-9+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        (r"[A-Za-z0-9_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    )
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed forms, by start and then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _hint):
        out += [("assign", m.start(), m.end()) for m in _assign.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _access.finditer(text)]
    out += [("hex", *m.span()) for m in _hex.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _normal(z: float) -> float:
    """Two-sided chance of |z|."""
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(token: str) -> float:
    """Fisher's joined p value of the three tests; small for what is not random in its own alphabet."""
    token = token.rstrip("=")
    n = len(token)
    alphabet = next((a for p, a in _ALPHABETS if p.fullmatch(token)), None)
    if alphabet is None or n < 8:
        return 0.0
    k = len(alphabet)
    s = np.fromiter(map(alphabet.__getitem__, token), dtype=np.int64, count=n)
    chi = float(((np.bincount(s, minlength=k) - n / k) ** 2).sum() * k / n)
    df = k - 1
    p_chi = 0.5 * math.erfc(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) / math.sqrt(2))
    above = 2 * s >= k
    ones = int(above.sum())
    zeros = n - ones
    if ones and zeros:
        mean = 2 * ones * zeros / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _normal((1 + int((above[1:] != above[:-1]).sum()) - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        p_runs = 0.5 ** (n - 1)
    x = s - s.mean()
    total = float((x * x).sum())
    p_serial = _normal((float((x[1:] * x[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def _bin(p: float) -> int:
    return min(BINS - 1, int(p * BINS))


def long_tokens(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, bin) of every long token."""
    return [(*m.span(), bisect_right(LENGTHS, m.end() - m.start()) - 1, _bin(randomness(m.group()))) for m in _token.finditer(text)]


def _each(f, x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(f, x.tolist()), dtype=np.float64, count=len(x))


def _joined(s: np.ndarray, k: int) -> np.ndarray:
    """``randomness`` of many tokens of one length: their places in an alphabet of ``k`` symbols, a token a row."""
    m, n = s.shape
    counts = np.bincount((s + np.arange(m)[:, None] * k).ravel(), minlength=m * k).reshape(m, k)
    chi = (np.einsum("ij,ij->i", counts, counts) - n * n / k) * k / n
    df = k - 1
    p_chi = 0.5 * _each(math.erfc, (np.cbrt(chi / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) / math.sqrt(2))
    above = 2 * s >= k
    ones = above.sum(axis=1)
    runs = 1 + (above[:, 1:] != above[:, :-1]).sum(axis=1)
    mean = 2 * ones * (n - ones) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = _each(math.erfc, np.abs(runs - mean) / np.sqrt(np.where(spread > 0, spread, 1)) / math.sqrt(2))
    p_runs = np.where((ones == 0) | (ones == n), 0.5 ** (n - 1), np.where(spread > 0, p_runs, 1.0))
    f = s.astype(np.float32)  # sums of products of whole numbers below 62, exact
    every, square, beside = (np.asarray(x, dtype=np.float64) for x in (s.sum(axis=1), np.einsum("ij,ij->i", f, f), np.einsum("ij,ij->i", f[:, 1:], f[:, :-1])))
    total = square - every * every / n
    beside = beside - every / n * (2 * every - s[:, 0] - s[:, -1]) + (n - 1) * (every / n) ** 2
    differs = n * square > every * every
    z = (beside / np.where(differs, total, 1) + 1 / n) * math.sqrt(n)
    p_serial = np.where(differs, _each(math.erfc, np.abs(z) / math.sqrt(2)), 0.0)
    half = -sum(np.log(np.maximum(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return np.exp(-half) * (1 + half + half * half / 2)


def _window_bins(windows: np.ndarray) -> np.ndarray:
    """How many of these tokens of letters, a token a row, fall into each bin."""
    upper, low = (windows < 97).all(axis=1), (windows >= 97).all(axis=1)
    hexed = ((windows | 32) <= 102).all(axis=1)  # a-f or A-F
    out = np.zeros(BINS, dtype=np.int64)
    for rows, k in ((low & hexed, 16), (upper & hexed, 16), (low & ~hexed, 26), (upper & ~hexed, 26), (~low & ~upper, 62)):
        if rows.any():
            s = windows[rows].astype(np.int64)
            s = s - 65 + np.where(s < 97, 0, -6) if k == 62 else (s | 32) - (87 if k == 16 else 97)
            out += np.bincount(np.minimum(BINS - 1, (_joined(s, k) * BINS).astype(np.int64)), minlength=BINS)
    return out


def prose_counts(some: Iterable[str]) -> dict[tuple[int, int], int]:
    """(length class, bin): number of the tokens that each text's own letters are cut into, at each length, whatever is left over."""
    letters = [np.frombuffer(t.encode("utf-8", "replace").translate(None, _not_letters), dtype=np.uint8) for t in some]
    out = Counter()
    for c, n in enumerate(LENGTHS):
        cut = [x[: len(x) // n * n] for x in letters]
        windows = np.concatenate([np.zeros(0, dtype=np.uint8), *cut]).reshape(-1, n)
        for i in range(0, len(windows), WINDOWS):
            found = _window_bins(windows[i : i + WINDOWS])
            out.update({(c, int(b)): int(found[b]) for b in np.flatnonzero(found)})
    return dict(out)


def discovery_cut(tokens: dict[tuple[int, int], int], prose: dict[tuple[int, int], int], rate: float = FALSE_DISCOVERY) -> list[int]:
    """The least bin of each length class that counts as a discovery (BINS: none).

    A token's p value is the share of prose at least as random at that length. Benjamini and Hochberg's rule takes the
    largest p value under rate * rank / number of tokens.
    """
    chance = {}
    for c in range(len(LENGTHS)):
        total, at_least = sum(n for (d, _), n in prose.items() if d == c), 0
        for b in range(BINS - 1, -1, -1):
            at_least += prose.get((c, b), 0)
            chance[c, b] = (1 + at_least) / (1 + total)
    seen, cut, every = 0, 0.0, sum(tokens.values())
    for key in sorted(tokens, key=lambda k: (chance[k], k)):
        seen += tokens[key]
        if chance[key] <= rate * seen / every:
            cut = chance[key]
    return [min((b for b in range(BINS) if chance[c, b] <= cut), default=BINS) for c in range(len(LENGTHS))]


def _join(spans: Iterable) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(ws: Workspace, docs: DataFrame) -> DataFrame:
    """doc_id, base spans and long tokens of every row, written to the shared folder: no texts.

    The prose of some rows is counted together, and the counts (at most length classes x bins) stand in the first of them.
    """
    # a text is read once: later passes need only what was found in it
    kind = "base array<struct<kind:string,start:int,end:int>>, tokens array<struct<start:int,end:int,length:int,bin:int>>, prose array<struct<length:int,bin:int,n:bigint>>"
    fields = {
        "base": pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),
        "tokens": pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "length", "bin")])),
        "prose": pa.list_(pa.struct([("length", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])),
    }

    def run(batches):
        for b in batches:
            found = {n: [] for n in fields}
            some = [t or "" for t in b.column("text").to_pylist()]
            for text in some:
                found["base"].append([dict(zip(("kind", "start", "end"), s)) for s in base_spans(text)])
                found["tokens"].append([dict(zip(("start", "end", "length", "bin"), s)) for s in long_tokens(text)])
            prose = [{"length": c, "bin": k, "n": n} for (c, k), n in prose_counts(some).items()]
            found["prose"] = [prose if i == 0 else [] for i in range(len(some))]
            keys = [b.column(n) for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(found[n], t) for n, t in fields.items())], [*(n for n in b.schema.names if n != "text"), *fields])

    keys = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return ws.save(docs.mapInArrow(run, ", ".join([*keys, kind])), "scanned")


def discoveries(found: DataFrame, rate: float) -> list[int]:
    """``discovery_cut`` of what ``scan`` wrote; at most length classes x bins counts of either kind reach the driver."""
    counted = lambda name, n: {(r[0], r[1]): r[2] for r in found.select(F.explode(name).alias("t")).groupBy("t.length", "t.bin").agg(F.sum(n)).collect()}
    return discovery_cut(counted("tokens", F.lit(1)), counted("prose", F.col("t.n")), rate)


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """doc_id, t1, t2 (the text's hash), base and spans: arrays of (kind, start, end) in code points, end exclusive.

    spans are those of the fixed forms and, of kind ``random``, long tokens that the battery picks and no fixed form touches.
    A null text counts as empty, and a text of any length is scanned whole. Rows that repeat a doc_id are scanned each on its
    own text, rows alike in all alike; tokens that tie in their chance are picked together or not at all. Other columns are passed over, whatever their names. Without tokens or prose nothing is
    added, and an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession)
    found = scan(ws, texts(docs).select("doc_id", *row_key(), F.coalesce("text", F.lit("")).alias("text")))
    least = F.array(*map(F.lit, discoveries(found, rate)))
    picked = F.filter(
        "tokens",
        lambda t: (t["bin"] >= F.get(least, t["length"])) & ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])),
    )
    extra = F.transform(picked, lambda t: F.struct(F.lit(EXTRA).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    order = F.array_sort(F.transform(F.concat("base", extra), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, (*KINDS, EXTRA))), s["kind"]).alias("n"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(order, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", "t1", "t2", "base", spans.alias("spans"))


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: list[tuple[int, int]], mask: str = "[secret]") -> str:
    """The text with every span, or union of overlapping spans, replaced."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_spans(text: str, least: list[int]) -> list[tuple[int, int]]:
    """(start, end) of what ``find_secrets`` finds in a text, given the least bin that it picks for each length class."""
    base = [(a, b) for _, a, b in base_spans(text)]
    return base + [(a, b) for a, b, c, k in long_tokens(text) if k >= least[c] and not any(s < b and a < e for s, e in base)]


def mask_texts(docs: DataFrame, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """The documents, with all their columns, with a mask in place of each secret; n_chars, if there, follows a changed text.

    Once the cut is known, a text is searched again where it lies: neither texts nor spans are shuffled or joined. A null text
    stays null and an empty one empty; a text of any length is searched whole, and each row by its own text. Columns keep their
    names and order, whatever they are called. An empty table stays empty.
    """
    ws = Workspace(docs.sparkSession)
    least = discoveries(scan(ws, texts(docs).select(F.coalesce("text", F.lit("")).alias("text"))), rate)
    ws.drop("scanned")

    @F.pandas_udf("string")
    def mask(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, secret_spans(t, least)) for t in text], dtype=object)

    new = free_name(docs, "masked")
    with_new = docs.withColumn(new, mask(F.col("text").cast("string")))
    put = {"text": F.col(new).alias("text")}
    if "n_chars" in docs.columns:
        kept = F.col("text").cast("string").eqNullSafe(F.col(new))
        put["n_chars"] = F.when(kept, F.col("n_chars")).otherwise(F.char_length(new).cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return with_new.select(*(put.get(c, F.col(f"`{c}`")) for c in docs.columns))


def op6_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
