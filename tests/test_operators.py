"""Operators on small frames against their definitions."""

import random

from palimpsest.functions import identity, text, vectors
from palimpsest.operators import digest, graph
from palimpsest.plans import catalog
from pyspark.sql import functions as F


def test_similar_pairs(spark):
    """All pairs, for thresholds that Jaccard's index decides and that containment decides."""
    rnd = random.Random(4)
    base = [f"w{i}x" for i in range(40)]
    rows = []
    for i in range(60):
        words = base[: rnd.randint(6, 40)] if i % 2 else rnd.sample(base, rnd.randint(6, 40))
        rows.append((f"m{i:02}", "s", "t", " ".join(w if rnd.random() > 0.1 else f"u{rnd.randrange(99)}y" for w in words)))
    df = spark.createDataFrame(rows, "id string, scope_id string, target string, content string")
    sets = {i: set(c.split()) for i, _, _, c in rows}
    for least in (0.3, 0.6, 0.7, 0.9):
        want = set()
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and max(both / len(sets[a] | sets[b]), 0.82 * both / min(len(sets[a]), len(sets[b]))) >= least:
                    want.add((a, b))
        assert {(r.a, r.b) for r in graph.similar_pairs(df, least).collect()} == want


def test_identity():
    assert identity.normalized("  Straße ﬁx ") == "strasse fix"
    assert identity.fact_key("A B", "is") == '["a b","is"]'
    assert identity.local_instant("2024-07-01T12:00:00", "Europe/Berlin").hour == 10
    for text_, zone in (("2024-03-31T02:30:00", "Europe/Berlin"), ("2024-10-27T02:30:00", "Europe/Berlin")):
        try:
            identity.local_instant(text_, zone)
        except ValueError:
            continue
        raise AssertionError(text_)


def test_embedding():
    v, none = vectors.embedder(dimensions=32).matrix(["alpha beta alpha", ""])
    assert len(v) == 32 and abs(sum(x * x for x in v) - 1) < 1e-9 and not none.any()


def test_segments(spark):
    rows = [("1", 1, "user", "garden flowers bloom"), ("1", 2, "assistant", "flowers need water"), ("1", 3, "user", "water daily"), ("1", 4, "user", "database indexes"), ("2", 1, "user", "hello there")]
    df = spark.createDataFrame(rows, "session_id string, turn_number int, role string, content string")
    assert sorted((r.session_id, r.turn_number, r.segment) for r in digest.segments(df).collect()) == [("1", 1, 0), ("1", 2, 0), ("1", 3, 0), ("1", 4, 1), ("2", 1, 0)]


def test_compact_and_nulls(spark):
    df = spark.createDataFrame([("a  b\n c", 3), (None, 1), ("x" * 9, 2)], "s string, n int")
    got = [r[0] for r in df.select(text.compact("s", 5), "n").orderBy("n").collect()]
    assert got == ["", "xxxx…", "a b c"]
    assert df.select(F.size(text.query_tokens("s"))).count() == 3


def test_stated_facts_meet_ascii_word_bounds(spark):
    """A name begins behind any letter that is no ASCII word letter, as in the SQL."""
    rows = spark.createDataFrame([("Mi cióncibo Is ontion de",), ("la éuser prefers tea",), ("acción_is ok",)], "s string")
    found = [[(f.category, f.content) for f in r.f] for r in rows.select(text.stated_facts("s").alias("f")).collect()]
    assert found == [[("fact", "Mi cióncibo Is ontion de.")], [("preference", "user prefers tea.")], []]


def test_similarity_at_a_threshold(spark):
    """0.82 of the containment is 0.82 * shared / words, in that order: 0.55 is not reached by a rounding of the quotient first."""
    row = spark.sql("SELECT transform(sequence(1, 82), x -> CAST(x AS STRING)) AS a, transform(sequence(28, 437), x -> CAST(x AS STRING)) AS b")
    assert row.select(text.similarity(F.col("a"), F.col("b"))).first()[0] == 0.82 * 55 / 82 < 0.55


def test_best_match_sorts_no_text(spark):
    """The newest rows of a target are found by their ids alone."""
    plan = catalog.QUERIES["j21_best_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
