import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from palimpsest.llm.quality import FACTORS, FEATURES, WORD_BUCKETS, FactorMachine, features, fit_machine, op1_quality_fm, quality_scores

DATA = Path("/root/testdata/sf0.01")


def test_identity():
    """The linear-time score is the sum over all pairs."""
    rng = np.random.default_rng(2)
    machine = FactorMachine(0.3, rng.normal(size=FEATURES), rng.normal(size=(FEATURES, FACTORS)) * 0.1)
    i, x = features(b"Some WORDS here, some more #words 12\nand a line!! ")
    z = 0.3 + sum(machine.linear[a] * v for a, v in zip(i, x))
    z += sum(machine.factors[i[p]] @ machine.factors[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p))
    assert abs(machine.score(i, x) - 1 / (1 + np.exp(-z))) < 1e-6


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_table_as_brute_force(spark):
    """Every row of a table against the sum over all pairs, with features counted by hand."""
    small = DATA.parent / "sf0.001"
    docs, labels = (spark.read.parquet(str(small / f"{t}.parquet")) for t in ("documents", "labels"))
    machine, rows = fit_machine(docs, labels), docs.collect()
    got = {r.doc_id: r for r in op1_quality_fm(spark, str(small)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        text = r.text.encode()
        weight = {}
        for w in text.lower().split():
            weight[w] = weight.get(w, 0) + 1
        norm = sum(weight.values()) ** 0.5 or 1.0
        x = np.zeros(FEATURES)
        for w, n in weight.items():
            x[zlib.crc32(w) % WORD_BUCKETS] += n**0.5 / norm
        square = np.zeros(FEATURES)
        for w, n in weight.items():
            square[zlib.crc32(w) % WORD_BUCKETS] += n / norm**2
        bins = [i for i in features(text, r.n_chars)[0] if i >= WORD_BUCKETS]
        x[bins], square[bins] = 1, 1
        used = np.flatnonzero(x)
        v = machine.factors[used].astype(float)
        pairs = (v @ v.T) * np.outer(x[used], x[used])
        # words that share a number are features of their own: each pair of them once, none with itself
        z = machine.bias + machine.linear[used] @ x[used] + np.triu(pairs, 1).sum() + 0.5 * ((v * v).sum(axis=1) * (x[used] ** 2 - square[used])).sum()
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-z))) < 1e-4


def test_metadata():
    """The stated length is an input; its lack, or nonsense in it, is a bin of its own."""
    a, b, c, d = (set(features(b"some text", n)[0].tolist()) for n in (9, 900, None, float("nan")))
    assert a != b and a != c and c == d and len(a ^ b) == 4
    assert set(features(b"some text", -3)[0].tolist()) == c


def test_repeated_doc_ids(spark):
    """Rows that repeat a labelled doc_id are learned from all alike, whatever their order and number."""
    rnd = random.Random(2)
    rows = [(i % 4, " ".join(rnd.choice("abcdefgh") * 3 for _ in range(20)), i) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    docs = lambda r: spark.createDataFrame(r, "doc_id long, text string, n_chars int")
    a, b = (fit_machine(docs(r).repartition(n), labels, rows=50) for r, n in ((rows, 3), (rows[::-1], 2)))
    assert np.array_equal(a.linear, b.linear) and np.array_equal(a.factors, b.factors)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_held_out(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"{t}.parquet")) for t in ("documents", "labels"))
    got = quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in unseen) / len(unseen) > 0.93


def test_edges(spark):
    rnd = random.Random(1)
    good = [(i, " ".join(rnd.choice("the of and is on by".split()) for _ in range(60)), "s") for i in range(40)]
    bad = [(100 + i, "$$$ buy !! " * 30, "s") for i in range(40)]
    odd = [(None, None, "s"), (500, "", "s"), (501, "x" * 200_000, "s"), (501, "again", "s"), (3, good[3][1], "s")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, score string")
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(None, 1), (500, None), (0, 0), (501, 7)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == 85 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert [by[i] for i in range(40)] == [1] * 40 and [by[100 + i] for i in range(40)] == [0] * 40
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    for extra in ("n_chars string", "y int, times int, key int, stated string"):
        wide = docs.selectExpr("*", *(f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in extra.split(", ")))
        assert quality_scores(wide, labels).count() == 85
    assert quality_scores(docs.limit(0), labels).count() == 0
