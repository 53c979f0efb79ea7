"""States, skew and folds against plain Python."""

import json
import random

import numpy as np
import pytest
from palimpsest.functions import evidence, text, vectors
from palimpsest.operators import digest, govern, graph, recall, relate, reports, scan, temporal
from palimpsest.sources import stores
from pyspark.sql import functions as F


def test_components_to_the_end(spark):
    """A chain of 200 ids and a star come to one head each."""
    rows = [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)] + [("hub", f"x{i}") for i in range(50)]
    random.Random(1).shuffle(rows)
    got = {r.id: r.head for r in govern.connected_in_group(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert {got[f"c{i:03}"] for i in range(201)} == {"c000"} and {got[f"x{i}"] for i in range(50)} == {"hub"}


def test_hot_key(spark):
    """Ranks of one hot key, of null keys and of rare ones; the oldest copy stays."""
    rows = [(f"{i:04}", "hot" if i % 3 else None if i % 2 else f"k{i}", i % 7) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, k string, v int").repartition(6)
    got = {r.id: r.place for r in scan.ranked(df, ["k"], [F.col("v"), F.col("id")], "place").collect()}
    for key in ("hot", None):
        own = sorted((v, i) for i, k, v in rows if k == key)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    pages = scan.pages(df.select("id", F.expr("timestamp'2024-01-01 00:00:00'").alias("updated_at")), 250).orderBy("page").collect()
    assert [(r.page, r.n, r.first_id, r.last_id) for r in pages] == [(0, 250, "0000", "0249"), (1, 250, "0250", "0499"), (2, 100, "0500", "0599")]


def test_insert_checked(spark):
    """Against all pairs of a slot."""
    rnd = random.Random(5)
    day = lambda n: None if n is None else f"2024-01-{n:02} 00:00:00"

    def make(p, n):
        out = []
        for i in range(n):
            a = rnd.randint(1, 25)
            ends = (rnd.choice([None, rnd.randint(1, 13)]), rnd.choice([None, rnd.randint(14, 27)])) if rnd.random() < 0.2 else (a, a + rnd.randint(1, 3))
            out.append((f"{p}{i}", "s", "u", "p", *map(day, ends)))
        return out

    schema = "claim_id string, scope_id string, subject_key string, predicate_key string, valid_from string, valid_to string"
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to")})
    old, new = make("o", 4), make("n", 60)
    hits = {n[0] for n in new if any(not (n[5] and o[4] and n[5] <= o[4]) and not (o[5] and n[4] and o[5] <= n[4]) for o in old)}
    got = {r.claim_id: r.rejected for r in temporal.insert_checked(frame(old), frame(new)).collect()}
    assert {k for k, v in got.items() if v} == hits and set(got) == {n[0] for n in new}


def test_trust_is_folded_in_order(spark):
    rnd = random.Random(2)
    rows = [(u, f"2024-01-{rnd.randint(1, 9):02} 0{rnd.randint(0, 9)}:00:00", i, rnd.choice([0.3, -0.4, 0.05])) for i in range(300) for u in ("a", "b")]
    df = spark.createDataFrame(rows, "u string, t string, n int, step double").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.u: r.trust for r in govern.trust(df, "u", ["t", "n"]).collect()}
    for u in ("a", "b"):
        x = 0.5
        for _, _, _, s in sorted((r for r in rows if r[0] == u), key=lambda r: (r[1], r[2])):
            x = min(1.0, max(0.0, x + s))
        assert abs(got[u] - x) < 1e-9


def test_embedder_as_defined(spark):
    """The vectors' words are the tokens of the engine; a store gives back the newest change."""
    said = ["Alpha beta alpha likes", "我的服务器运行在哪里", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "id int, s string")
    rows = df.select("id", text.query_tokens("s").alias("w"), vectors.embed(F.col("s"), vectors.embedder(dimensions=32)).alias("v")).orderBy("id").collect()
    for r, s in zip(rows, said):
        assert r.w == vectors.words(s)
        assert abs(sum(x * x for x in r.v) - (1 if r.w else 0)) < 1e-9
    with pytest.raises(ValueError):
        vectors.embedder("none")
    store = stores.store(spark)
    put = lambda x: spark.createDataFrame([("a", "s", [x]), ("b", "s", [x])], "id string, scope_id string, vector array<double>").withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    store.upsert(put(1.0))
    store.upsert(put(2.0).where("id = 'a'"))
    store.delete(put(1.0).where("id = 'b'").select("id"))
    assert [(r.id, r.vector) for r in store.read().collect()] == [("a", [2.0])] and store.audit().first().physical == 4


def test_queries_in_blocks(spark):
    """A batch of several blocks gives what one block gives."""
    rnd = random.Random(8)
    store = spark.createDataFrame([(f"v{i}", [rnd.random() for _ in range(6)]) for i in range(90)], "id string, vector array<double>").repartition(5)
    asked = store.where("id < 'v3'").select(F.col("id").alias("query_id"), "vector")
    for metric in ("cosine", "l2", "dot"):
        one = recall.vector_candidates(store, asked, 4, metric).collect()
        assert sorted(map(tuple, recall.vector_candidates(store, asked, 4, metric, most=3).collect())) == sorted(map(tuple, one))
    x = np.array([r.vector for r in store.collect()])
    assert np.allclose(vectors.distances_to(x, x[:2], "l2")[:, 1], np.sqrt(((x - x[1]) ** 2).sum(axis=1)))


def test_sanitized_json(spark):
    value = {"api_key": "x", "a": [{"note": "token = abc in /home/me/x"}, 3, None], "deep": {"k": {"password": "p"}}}
    for _ in range(3):
        value = {"w": value}
    df = spark.createDataFrame([(json.dumps(value),), ("no json token: q",), (None,)], "s string")
    got = [r[0] for r in df.select(text.sanitize_json("s")).collect()]
    inner = json.loads(got[0])["w"]["w"]["w"]
    assert inner == {"[REDACTED_KEY]": "x", "a": [{"note": "token=[REDACTED] in [REDACTED_PATH]"}, 3, None], "deep": {"k": {"[REDACTED_KEY]": "p"}}}
    assert got[1:] == ["no json token=[REDACTED]", None]


def test_claims_and_quotes(spark):
    rows = [
        ("Bob works at Acme", "works at", "Acme", True, False), ("Bob worked at Acme", "works at", "Acme", False, False), ("If Bob works at Acme we win", "works at", "Acme", False, False),
        ("Bob no longer works at Acme", "works at", "Acme", False, True), ("Bob works at Acme until June", "works at", "Acme", False, False), ("Acme is where Bob works at", "works at", "Acme", False, False),
        ("Bob maybe works at Acme", "works at", "Acme", False, False), ("Bob works at No Name now", "works at", "No Name", True, False),
    ]
    df = spark.createDataFrame(rows, "q string, p string, v string, yes boolean, back boolean")
    both = [f(F.col("q"), F.lit("user_message"), F.lit("Bob"), F.col("p"), F.col("v")) for f in (evidence.supports, evidence.retracts)]
    for r in df.select("q", "yes", "back", both[0].alias("s"), both[1].alias("r")).collect():
        assert (r.s, r.r) == (r.yes, r.back), r.q


def test_overflow_and_chunks(spark):
    with pytest.raises(ValueError):
        temporal.bounded(spark.range(5), 4)
    assert temporal.bounded(spark.range(4), 4).count() == 4
    df = spark.createDataFrame([("0 one. " * 4 + "10",)], "s string")
    got = df.select(scan.chunks(F.col("s"), 12)).first()[0]
    assert "".join(got).replace(" ", "") == ("0one." * 4) + "10" and all(len(p) <= 12 for p in got)


def test_rebuild_keeps_what_was_said_by_hand(spark):
    key = "source_memory_id string, target_memory_id string, relation_type string, confidence double"
    old = spark.createDataFrame([("a", "b", "affects", 0.5, True), ("a", "c", "affects", 0.5, False), ("x", "y", "affects", 0.5, True)], key + ", extracted boolean")
    new = spark.createDataFrame([("a", "d", "affects", 0.7), ("a", "c", "affects", 0.7), ("x", "z", "affects", 0.7)], key)
    got = relate.rebuilt(old, new, spark.createDataFrame([("a",)], "id string"))
    assert sorted((r[0], r[1], r.extracted) for r in got.collect()) == [("a", "c", False), ("a", "d", True), ("x", "y", True)]


def test_duplicates_and_copies(spark):
    rows = [(f"{i}", "s", "t", "same" if i < 40 else f"k{i}", f"2024-01-01 00:00:{i % 60:02}") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, scope_id string, target string, dedup_key string, created_at string").withColumns({"updated_at": F.col("created_at"), "content": F.lit("long enough to stay here, it is"), "source": F.lit("x"), "metadata": F.lit("{}")})
    assert sorted(r.place for r in reports.duplicates(df, ["dedup_key"]).collect()) == list(range(1, 41))
    assert {r.id for r in reports.forgetting(df).where("reason = 'duplicate-memory'").collect()} == {f"{i}" for i in range(1, 40)}
    assert graph.peers(spark.createDataFrame([], "scope_id string, memory_id string, entity string"), df.select("scope_id", "id", "updated_at"), 3).groupBy("memory_id").count().where("count = 3").count() == 60
    assert digest.classified is not None
