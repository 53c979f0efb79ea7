"""Quality classifier: a factorisation machine (Rendle 2010) over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is half of (sum v_i x_i)^2 - sum (v_i x_i)^2
for each factor, so that a text is scored in time linear in its features. The machine is fitted with Adam on a bounded sample
of labelled rows and is then a constant of some hundred kB; every row is scored where it lies.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Labelled rows that the machine is fitted on at most: the bound of what reaches the driver.
FIT_ROWS = 12_000
WORD_BUCKETS = 1 << 13
FACTORS = 8
KEEP = 0.3
_SYMBOLS = b"#*$%&|<>"
_digit, _punct, _upper = re.compile(rb"[0-9]"), re.compile(rb"[!-/:-@\[-`{-~]"), re.compile(rb"[A-Z]")
BINS = 12
#: Upper ends of the bins of each statistic; what is above all of them has the last bin.
EDGES = {
    "words": (1, 5, 10, 20, 50, 100, 200, 400, 800, 2000, 5000),
    "bytes": (16, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 65536),
    "word_bytes": (1.5, 2.5, 3.5, 4.2, 4.8, 5.4, 6.0, 6.8, 7.6, 9.0, 12.0),
    "distinct": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.95),
    "top_word": (0.01, 0.02, 0.04, 0.06, 0.09, 0.12, 0.16, 0.2, 0.3, 0.5, 0.8),
    "upper": (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "digits": (0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6),
    "marks": (0.0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.4),
    "symbols": (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 2.0),
    "lines": (0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.9),
    "dup_lines": (0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 0.95),
    "dup_pairs": (0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8, 0.95),
    "shout": (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    # metadata: the length that the table states, and that length against the text's own (-1: not stated)
    "stated": (-1, 0, 16, 64, 128, 256, 512, 1024, 2048, 8192, 65536),
    "stated_share": (-1, 0, 0.1, 0.5, 0.8, 0.95, 0.999, 1.001, 1.05, 1.25, 2.0),
}
#: Column of metadata that is an input. Labels, lang, source and doc_id never are.
STATED = "n_chars"
_EDGES = np.array(list(EDGES.values()))
_OFFSETS = WORD_BUCKETS + BINS * np.arange(len(EDGES))
FEATURES = WORD_BUCKETS + BINS * len(EDGES)


def features(text: bytes | None, stated: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: hashed words of unit norm, and one bin of every statistic and of the metadata.

    A null text counts as empty. ``stated`` is the length in characters that the table gives (null or NaN: none).
    """
    text = text or b""
    stated = -1.0 if stated is None or not stated >= 0 else float(stated)
    words = text.lower().split()
    n, size = max(1, len(words)), max(1, len(text))
    count = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    stats = (
        len(words),
        len(text),
        len(text) / n,
        len(count) / n,
        max(count.values(), default=0) / n,
        len(_upper.findall(text)) / size,
        len(_digit.findall(text)) / size,
        len(_punct.findall(text)) / size,
        sum(map(text.count, (_SYMBOLS[i : i + 1] for i in range(len(_SYMBOLS))))) / n,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
        (text.count(b"!!") + text.count(b"??")) / n,
        stated,
        stated / max(1, len(text.decode("utf-8", "replace"))) if stated >= 0 else -1,
    )
    bins = (np.asarray(stats)[:, None] > _EDGES).sum(axis=1) + _OFFSETS
    hashed = np.fromiter(map(zlib.crc32, count), dtype=np.int64, count=len(count)) % WORD_BUCKETS
    weight = np.sqrt(np.fromiter(count.values(), dtype=np.float32, count=len(count)))
    norm = np.sqrt((weight * weight).sum()) or 1.0
    return np.concatenate([hashed, bins]).astype(np.int32), np.concatenate([weight / norm, np.ones(len(bins))]).astype(np.float32)


@dataclass
class FactorMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, steps: int = 300, rate: float = 0.02, decay: float = 1e-5, batch: int = 256, seed: int = 7) -> FactorMachine:
        """Adam on the logistic loss, for ``epochs`` passes and ``steps`` batches at least. Without rows the machine scores everything 0.5; with one class, near that class."""
        rng = np.random.default_rng(seed)
        w, v = np.zeros((FEATURES, 1 + FACTORS), dtype=np.float32), rng.normal(0, 0.02, (FEATURES, FACTORS)).astype(np.float32)
        w[:, 1:] = v if rows else 0
        mean = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        bias = np.log(mean / (1 - mean))
        m1, m2, step = np.zeros_like(w), np.zeros_like(w), 0
        batches = -(-len(rows) // batch)
        for _ in range(max(epochs, -(-steps // batches)) if rows else 0):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), batch):
                chosen = order[start : start + batch]
                index = np.concatenate([rows[i][0] for i in chosen])
                value = np.concatenate([rows[i][1] for i in chosen])
                ends = np.cumsum([0, *(len(rows[i][0]) for i in chosen)])
                part = w[index] * value[:, None]
                sums = np.add.reduceat(part, ends[:-1], axis=0)
                squares = np.add.reduceat(part[:, 1:] ** 2, ends[:-1], axis=0)
                z = bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(axis=1)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) / len(chosen)
                each = np.repeat(np.arange(len(chosen)), np.diff(ends))
                slope = np.empty_like(part)
                slope[:, 0] = value
                slope[:, 1:] = value[:, None] * (sums[each, 1:] - part[:, 1:])
                slope *= error[each, None]
                used, back = np.unique(index, return_inverse=True)
                g = np.zeros((len(used), w.shape[1]), dtype=np.float32)
                for c in range(w.shape[1]):
                    g[:, c] = np.bincount(back, slope[:, c], len(used))
                g += decay * w[used]
                step += 1
                m1[used] = 0.9 * m1[used] + 0.1 * g
                m2[used] = 0.99 * m2[used] + 0.01 * g * g
                w[used] -= rate * (m1[used] / (1 - 0.9 ** min(step, 500))) / (np.sqrt(m2[used] / (1 - 0.99 ** min(step, 2000))) + 1e-8)
                bias -= rate * float(error.sum())
        return FactorMachine(float(bias), w[:, 0].copy(), w[:, 1:].copy())

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        part = self.factors[index] * value[:, None]
        z = self.bias + float(self.linear[index] @ value) + 0.5 * float((part.sum(axis=0) ** 2).sum() - (part * part).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _body_and_stated(docs: DataFrame) -> tuple[Column, Column]:
    """The inputs of a score. The metadata is null where the table has no such column, or one that is no number."""
    kind = dict(docs.dtypes).get(STATED, "").split("(")[0]
    stated = F.col(STATED) if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") else F.lit(None)
    return F.col("text").cast("string").cast("binary"), stated.cast("double")


def _inputs(docs: DataFrame) -> DataFrame:
    body, stated = _body_and_stated(docs)
    return docs.select("doc_id", body.alias("text"), stated.alias("stated"))


def fit_machine(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> FactorMachine:
    """Fit on labelled rows of the learning folds, ``rows`` at most: those whose hash of doc_id and text is smallest.

    Labels go by doc_id, so that rows which repeat one count each with its own text.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    inputs = _inputs(docs)
    keys = inputs.select("doc_id", F.xxhash64("doc_id", "text", "stated").alias("key")).join(known, "doc_id")
    keys = keys.orderBy("key", "doc_id").limit(rows).groupBy("doc_id", "key", "y").agg(F.count(F.lit(1)).alias("times"))

    def run(batches):
        for b in batches:
            found = [features(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("stated").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("times"), pa.array([i.astype(np.uint16).tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["y", "times", "i", "v"])

    chosen = inputs.withColumn("key", F.xxhash64("doc_id", "text", "stated")).join(F.broadcast(keys), ["doc_id", "key"])
    chosen = chosen.dropDuplicates(["doc_id", "key"]).select("y", "times", "text", "stated")  # a key stands for rows alike in all: ``times`` of them
    got = chosen.mapInArrow(run, "y int, times bigint, i binary, v binary").toArrow()  # ``rows`` rows at most
    found = sorted(zip(*(got.column(c).to_pylist() for c in ("i", "v", "y", "times"))))
    del got
    pairs = [(np.frombuffer(i, np.uint16), np.frombuffer(v, np.float32)) for i, v, _, n in found for _ in range(n)]
    return FactorMachine.fit(pairs, np.array([y for *_, y, n in found for _ in range(n)], dtype=np.float32))


def scorer(machine: FactorMachine):
    """A column function: binary text and stated length to score."""

    @F.pandas_udf("double")
    def score(text: pd.Series, stated: pd.Series) -> pd.Series:
        return pd.Series([machine.score(*features(t, n)) for t, n in zip(text, stated)], dtype="float64")

    return score


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents, with all their columns, that a machine fitted on their labels scores ``keep`` or more.

    Null texts are scored as empty ones and rows that repeat a doc_id each by its own text, of any length; a score of exactly
    ``keep`` stays. Without usable labels every score is 0.5, so that all stay. Columns keep their names and order, whatever they
    are called. An empty table stays empty.
    """
    return docs.where(scorer(fit_machine(docs, labels))(*_body_and_stated(docs)) >= keep)


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, keep: float = KEEP) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null text is scored as empty. Labels other than 0 and 1, and those without a doc_id, are passed over; a doc_id labelled
    both ways counts as 1. Without labels every score is 0.5. Rows that repeat a doc_id are scored each on its own text,
    rows alike in all alike, and a text of any length whole. Of other columns only ``n_chars`` is read, if it is a number. An
    empty table gives an empty result.
    """
    score = scorer(fit_machine(docs, labels, rows))
    rated = _inputs(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text", "stated").alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= keep).cast("int"))


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
