"""Language identification by nearest centroid.

A text is the TF-IDF vector of its hashed byte n-grams, of unit length. Each language has several centroids, found by
spherical k-means over a bounded sample of texts of known language; the nearest centroid by cosine gives the language, and a
cosine under what the language's own sample reaches marks the text as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, row_key, texts

#: Texts of known language that centroids are fitted on, about: in all, and for each language at most and at least.
FIT_ROWS, FIT_PER_LANGUAGE, FIT_LEAST = 4_000, 1_000, 40
CENTROIDS = 4
BUCKETS = 1 << 12
#: Bytes of learning texts' counts that reach the driver at most, and of the model: with very many languages both shrink.
FIT_BYTES, MODEL_BYTES, LEAST_BUCKETS = 64 << 20, 64 << 20, 32
#: A text is rejected under this quantile of the cosines of its language's sample.
REJECT_AT = 0.005
UNKNOWN = "und"
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
#: Bytes of A-Z and digits in the form in which they are counted.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32


def counts(text: bytes) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-byte grams. UTF-8 letters beyond ASCII are two or more bytes, so that these see them."""
    b = _FOLD[np.frombuffer(text, dtype=np.uint8)].astype(np.uint64)
    out = np.zeros(BUCKETS, dtype=np.int64)
    with np.errstate(over="ignore"):
        code = b + np.uint64(1)
        for n in range(3):
            if len(b) <= n:
                break
            if n:
                code = (code[:-1] << np.uint64(8)) + b[n:] + np.uint64(1)
            hashed = (code * _MULT[n]) >> np.uint64(52)
            out += np.bincount(hashed.astype(np.int64), minlength=BUCKETS)
    return out


def folded(count: np.ndarray, size: int) -> np.ndarray:
    """Counts of fewer buckets: each holds what several held."""
    return count if len(count) == size else count.reshape(-1, size).sum(axis=0)


def layout(languages: int, k: int, model_bytes: int = MODEL_BYTES) -> tuple[int, int]:
    """(centroids a language, buckets) of a model of so many languages that fits; fewer centroids go first, then buckets."""
    size = BUCKETS
    while 4 * max(1, languages) * k * size > model_bytes and (k > 1 or size > LEAST_BUCKETS):
        k, size = (k - 1, size) if k > 1 else (k, size // 2)
    return k, size


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Centroids:
    idf: np.ndarray
    languages: list[str]
    of: np.ndarray
    vectors: np.ndarray
    least: np.ndarray

    def vector(self, count: np.ndarray) -> np.ndarray:
        x = (np.log1p(folded(count, len(self.idf))) * self.idf).astype(np.float32)
        return x / max(float(np.sqrt((x * x).sum())), 1e-9)

    @staticmethod
    def fit(rows: list[tuple[str, np.ndarray]], k: int = CENTROIDS, size: int = BUCKETS, rounds: int = 8, seed: int = 3) -> Centroids:
        """Spherical k-means for each language. Fewer texts than centroids: a centroid for each text."""
        rng = np.random.default_rng(seed)
        names = sorted({lang for lang, _ in rows})
        raw = np.array([c for _, c in rows], dtype=np.int32).reshape(len(rows), size)
        idf = np.log((1 + len(rows)) / (1 + (raw > 0).sum(axis=0))) + 1
        model = Centroids(idf.astype(np.float32), names, np.zeros(0, int), np.zeros((0, size), np.float32), np.zeros(0))
        of, vectors, least = [], [], []
        x = np.array([model.vector(c) for c in raw], dtype=np.float32).reshape(len(rows), size)
        number = {lang: n for n, lang in enumerate(names)}
        langs = np.array([number[lang] for lang, _ in rows], dtype=np.int64)
        order = np.argsort(langs, kind="stable")
        for n, own in enumerate(np.split(order, np.flatnonzero(np.diff(langs[order])) + 1) if rows else ()):
            own = x[own]
            c = own[rng.choice(len(own), min(k, len(own)), replace=False)]
            for _ in range(rounds):
                near = (own @ c.T).argmax(axis=1)
                for j in range(len(c)):
                    if (near == j).any():
                        mean = own[near == j].mean(axis=0)
                        c[j] = mean / max(float(np.linalg.norm(mean)), 1e-9)
            of += [n] * len(c)
            vectors.append(c)
            least.append(float(np.quantile((own @ c.T).max(axis=1), REJECT_AT)))
        return Centroids(model.idf, names, np.array(of, int), np.concatenate(vectors) if vectors else model.vectors, np.array(least))

    def predict(self, count: np.ndarray) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid, and whether that is too far."""
        if not self.languages:
            return UNKNOWN, 0.0, True
        cosine = self.vectors @ self.vector(count)
        best = int(cosine.argmax())
        score = float(min(max(cosine[best], 0.0), 1.0))
        return self.languages[self.of[best]], score, score < self.least[self.of[best]]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def shares(known: DataFrame, rows: int, per_language: int, least: int) -> dict[str, float]:
    """The share of each language's texts that is learned from, so that every language has about its quota.

    The quota is ``rows`` divided among the languages, between ``least`` and ``per_language``; a language of fewer texts is
    taken whole. Texts are counted approximately and as different texts, so that copies take no other text's place. One
    number a language reaches the driver, as its centroids do.
    """
    counted = {r[0]: r[1] for r in known.groupBy("lang").agg(F.approx_count_distinct("t1", 0.02)).collect()}
    quota = max(least, min(per_language, rows // max(1, len(counted))))
    # 1.1: neither the error of the count nor chance should leave a small language out
    return {lang: 1.0 if n <= 1.1 * quota else quota / n for lang, n in counted.items()}


def fit_centroids(docs: DataFrame, rows: int = FIT_ROWS, per_language: int = FIT_PER_LANGUAGE, k: int = CENTROIDS, least: int = FIT_LEAST) -> Centroids:
    """Fit on the learning rows whose hash is below their language's share (see ``shares``); equal texts count once.

    About ``rows`` texts reach the driver, or ``least`` a language if that is more, and however many languages there are no more
    than about ``FIT_BYTES``, or one text a language: with very many, ``least`` goes down and counts are kept in fewer buckets,
    so that the model stays within ``MODEL_BYTES``. Nothing is ranked and no language meets in one task: a row is chosen by its
    own hash.
    """
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where("text is not null and lang is not null").where(~held_out(F.col("doc_id"))).where(F.col("text").rlike(r"\p{L}"))
    known = known.select("lang", *row_key(), "text")
    languages = known.select("lang").distinct().count()
    k, size = layout(languages, k)
    least = max(1, min(least, FIT_BYTES // (2 * size * max(1, languages))))
    taken = docs.sparkSession.createDataFrame(list(shares(known, rows, per_language, least).items()), "lang string, share double")
    place = F.shiftrightunsigned(F.xxhash64("t1", "t2"), 11) / F.lit(float(1 << 53))

    def run(batches):
        for b in batches:
            found = [np.minimum(folded(counts(t.encode()), size), 65535).astype(np.uint16).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(found, pa.binary())], ["lang", "c"])

    chosen = known.withColumn("place", place).join(F.broadcast(taken), "lang").where("place < share").dropDuplicates(["lang", "t1", "t2"]).select("lang", "text")
    got = chosen.mapInArrow(run, "lang string, c binary").toArrow()
    found = sorted(zip(got["lang"].to_pylist(), got["c"].to_pylist()))
    del got
    return Centroids.fit([(lang, np.frombuffer(c, np.uint16)) for lang, c in found], k, size)


def identify(docs: DataFrame, rows: int = FIT_ROWS, per_language: int = FIT_PER_LANGUAGE, k: int = CENTROIDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row.

    ``und`` and score 0 if the text is null or has no letter, or if nothing could be learned. rejected marks texts far from
    every centroid; they keep the nearest language, and of equally near centroids the first by language name. A text of any
    length is counted whole. Rows that repeat a doc_id are judged each on its own text. Columns other than doc_id, text and
    lang are passed over, whatever their names. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_centroids(docs, rows, per_language, k))  # MODEL_BYTES at most

    def run(batches):
        model = shared.value
        for b in batches:
            found = [model.predict(counts(t.encode())) if has_letter(t) else (UNKNOWN, 0.0, True) for t in b.column("text").to_pylist()]
            lang, score, far = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rated = texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rated.mapInArrow(run, f"doc_id {rated.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def op8_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
