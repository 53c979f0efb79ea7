import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm.language import BUCKETS, MODEL_BYTES, Centroids, counts, fit_centroids, has_letter, identify, layout, op8_language_centroids, shares

DATA = Path("/root/testdata/sf0.01")
WORDS = {"en": "the of and to in is that for it was", "de": "der die und in den von zu das mit sich", "fr": "de la le et les des en un du une"}


def test_counts():
    assert counts(b"").sum() == 0 and counts(b"a").sum() == 1 and counts("é".encode()).sum() == 3
    assert (counts(b"AbC 12\n") == counts(b"abc 34 ")).all() and counts(b"abcd").sum() == 4 + 3 + 2
    assert not has_letter("12 .!") and not has_letter(None) and has_letter("1é")


def test_nearest_is_brute_force():
    rng = np.random.default_rng(1)
    model = Centroids.fit([(lang, counts(" ".join(rng.permutation(w.split())[:7]).encode())) for lang, w in WORDS.items() for _ in range(20)])
    for lang, w in WORDS.items():
        got, score, _ = model.predict(counts(w.encode()))
        x = np.log1p(counts(w.encode())) * model.idf
        cosines = [float(c @ x / np.linalg.norm(x) / np.linalg.norm(c)) for c in model.vectors]
        assert got == lang and score == pytest.approx(max(cosines), abs=1e-4)
    assert Centroids.fit([]).predict(np.zeros(BUCKETS, int))[0] == "und"


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_held_out(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in unseen) / len(unseen) > 0.97


def test_many_and_rare_languages(spark):
    """However many languages there are, each is learned, also those of one text; copies do not crowd others out."""
    rnd = random.Random(5)
    words = {f"l{n:02}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for n in range(41)}
    rows = [(i * 41 + n, " ".join(rnd.sample(w, 8)), lang) for n, (lang, w) in enumerate(words.items()) for i in range(12)]
    rows += [(10_000 + i, "the same text of a copy", "l00") for i in range(3000)]
    rare = next(d for d in range(90_000, 90_100) if zlib.crc32(str(d).encode()) % 3 != 1)
    rows.append((rare, "zq zq qz qqz zzq", "rare"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    model = fit_centroids(docs, rows=100, k=2)
    assert model.languages == sorted([*words, "rare"])
    got = identify(docs, rows=100, k=2).join(docs, ["doc_id"]).where("doc_id < 10000").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    counted = shares(docs.selectExpr("lang", "xxhash64(text) as t1"), 100, 1000, 5)
    assert counted["rare"] == 1 and counted["l00"] < 0.6 and counted["l05"] == pytest.approx(5 / 12, rel=0.3)


def test_very_many_languages(spark):
    """20,000 of them: what reaches the driver and the model stay bounded, and texts still find their language."""
    assert layout(4, 4) == (4, BUCKETS) and all(4 * n * np.prod(layout(n, 4)) <= MODEL_BYTES for n in (1, 100, 1_000, 20_000, 500_000))
    rnd, rows = random.Random(6), []
    for n in range(20_000):
        word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))
        rows += [(3 * n + i, f"{word} {word[::-1]} {word[i:]}", f"l{n:05}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    model = fit_centroids(docs)
    assert model.vectors.nbytes <= MODEL_BYTES and len(model.languages) > 15_000
    some = identify(docs).join(docs.where("doc_id % 50 = 0"), "doc_id").where(F.col("lang").isin(model.languages)).collect()
    assert sum(r.lang_pred == r.lang for r in some) / len(some) > 0.9


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_table_as_brute_force(spark):
    """Every row against cosines summed term by term."""
    small = DATA.parent / "sf0.001"
    docs = spark.read.parquet(str(small / "documents.parquet"))
    model = fit_centroids(docs)
    got = {r.doc_id: r for r in op8_language_centroids(spark, str(small)).collect()}
    for r in docs.collect():
        x = [math.log1p(n) * float(w) for n, w in zip(counts(r.text.encode()), model.idf)]
        length = math.sqrt(sum(a * a for a in x)) or 1.0
        cosines = [sum(a * float(b) for a, b in zip(x, c) if a) / length for c in model.vectors]
        best = max(range(len(cosines)), key=cosines.__getitem__) if cosines else None
        if has_letter(r.text):
            assert got[r.doc_id].score == pytest.approx(min(1, max(0, cosines[best])), abs=1e-4)
            assert cosines[[i for i, of in enumerate(model.of) if model.languages[of] == got[r.doc_id].lang_pred][0]] <= cosines[best] + 1e-4
        else:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)


def test_edges(spark):
    rows = [(i, w * (1 + i % 3), lang, "c") for i in range(40) for lang, w in WORDS.items()]
    rows += [(900, None, "en", "c"), (901, "", None, "c"), (902, "12 34", "en", "c"), (None, WORDS["de"], "de", "c"), (903, (WORDS["fr"] + " ") * 5000, None, "c"), (903, WORDS["en"], None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = identify(df).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert sorted(r.lang_pred for r in got if r.doc_id in (900, 901, 902)) == ["und"] * 3
    assert sorted(r.lang_pred for r in got if r.doc_id == 903) == ["en", "fr"]
    assert {r.lang_pred for r in identify(df.where("lang is null")).collect()} == {"und"}
    assert identify(df.limit(0)).count() == 0
