"""Questions and rows met as classes, against all pairs."""

import random

import pytest
from palimpsest.operators import classes
from palimpsest.plans import catalog
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides(spark):
    rnd = random.Random(7)
    some = lambda: rnd.sample("abcdefgh", rnd.choice((0, 1, 1, 2, 3)))
    rows = [(f"{i:03}", ["a", "b"] if i % 3 == 0 else some()) for i in range(400)]
    asked = [(f"q{i}", some()) for i in range(60)] + [("all", list("abcdefgh")), ("none", ["z"])]
    frame = lambda x, name: spark.createDataFrame(x, f"{name} string, keys array<string>")
    return asked, rows, frame(asked, "query_id"), frame(rows, "id")


def test_apart(sides):
    asked, rows, q, r = sides
    want = {}
    for name, ks in asked:
        other = [i for i, own in rows if ks and own and not set(ks) & set(own)]
        if other:
            want[name] = (len(other), min(other))
    got = classes.apart(q, r)
    assert {x.query_id: (x.n, x["first"]) for x in got.collect()} == want


def test_scope_mismatch_pairs_nothing(spark):
    """Notes of different projects are counted by difference: no join without a key."""
    plan = catalog.QUERIES["p12_scope_mismatch"](spark, DATA)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sharing(sides):
    asked, rows, q, r = sides
    want = {(n, i): len(set(ks) & set(own)) for n, ks in asked for i, own in rows if set(ks) & set(own)}
    got = classes.sharing(q, r, F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == len(want) and {(x.query_id, x.id): x.n for x in got} == want


@pytest.mark.parametrize("name", ["n12_cjk_substring_score", "j2_ngram_postings"])
def test_questions_meet_texts_as_classes(spark, name):
    """What is dealt to the tasks are chunks of classes: no join makes a row for each pair of a question and a text."""
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(ids") < plan.index("Join") and "query_ids" in plan



@pytest.mark.parametrize("name", ["p12_scope_mismatch", "n12_cjk_substring_score", "j2_ngram_postings"])
def test_every_7th_note_asks(spark, name):
    asked = {int(r.query_id) for r in catalog.QUERIES[name](spark, DATA).select("query_id").distinct().collect()}
    assert asked and all(i % 7 == 0 for i in asked) and any(i % 50 for i in asked)
