"""Digest rules by hand: what is pollution and what is not, tense and stance, quarantine of a batch, and merged texts."""

import random
import re

import pytest
from palimpsest.functions import evidence
from palimpsest.operators import digest, govern
from pyspark.sql import functions as F

POLLUTED = {
    "task_state_snapshot": ["T12-index: in progress", "next_action is to deploy", "当前任务：发布", "PLAN_STATE updated"],
    "test_run_snapshot": ["12 tests passed", "3 failed", "the test suite is green", "测试全部通过", "pytest says all green"],
    "repository_audit_snapshot": ["commit 0123abcd", "HEAD: 0123abcdef", "git status is clean", "branch: main", "see PR #12", "release 4"],
    "historical_snapshot": ["Historical task snapshot of May", "截至 2024-05", "上下文压缩"],
}
CLEAN = ["Alice prefers tea", "the gate depends on the cache", "commitments matter", "T-shirts are pending", "a branch of the family", "用户喜欢茶", "the suite at the hotel"]
TRACES = ['{"output": 1}', r"see \\share\folder\x", r"%TEMP%\x.log", "/home/al/notes", r"C:\temp", "call_0123abcdE", "Traceback (most recent call last):", "git -C /x"]
TENSE = {
    "conditional": ["if it rains she works there", "unless they move", "如果发布"],
    "future": ["he will work there", "next semester she works there", "明天部署"],
    "temporary": ["she works there for three weeks", "he lives there this summer", "for a few months he lives there", "works from may to july", "during the winter he lives there", "in march he works at it", "on a contract he works there", "for the rest of the year", "暂时住在上海"],
    "past": ["he worked at acme", "formerly at acme", "in 2019 at acme", "last winter at acme", "曾经在上海"],
    "current_durable": ["she currently works at acme", "目前住在上海"],
    "unknown": ["alice works at acme", "maybelline is a brand"],
}


@pytest.mark.parametrize("kind", POLLUTED)
def test_pollution(kind):
    assert [t for t in POLLUTED[kind] if not re.search(evidence.POLLUTION[kind], t)] == []
    assert [t for t in CLEAN if re.search(evidence.POLLUTION[kind], t)] == []


def test_traces():
    assert [t for t in TRACES if not re.search(evidence.RAW_TRACE, t)] == [] and [t for t in CLEAN if re.search(evidence.RAW_TRACE, t)] == []
    assert re.search(evidence.NORMATIVE_GATE, "a release requires at least 200 tests passed") and not re.search(evidence.NORMATIVE_GATE, "200 tests passed")


def test_tense(spark):
    rows = [(k, t) for k, ts in TENSE.items() for t in ts]
    got = spark.createDataFrame(rows, "want string, t string").withColumn("got", evidence.durable_class(F.col("t"))).where("want <> got").collect()
    assert got == []


def test_supports(spark):
    rows = [("Alice works at Acme", True), ("Alice works at Acme for two years", False), ("According to Bob, Alice works at Acme", False), ("Alice might say she works at Acme", False), ("Alice no longer works at Acme", False), ("In May Alice works at Acme", False)]
    frame = spark.createDataFrame(rows, "q string, want boolean")
    said = evidence.supports(F.col("q"), F.lit("user_message"), F.lit("Alice"), F.lit("works at"), F.lit("Acme"))
    assert frame.withColumn("got", said).where("want <> got").collect() == []


def test_quarantine(spark):
    """Each reason alone and together; a value that others of its slot contradict takes them all."""
    long = " ".join(f"word{k}" for k in range(200))
    rows = [
        ("clean", "s1", "factual", "the cache is blue", "u1", "single", "add", "blue"), ("copy", "s1", "factual", long, "u2", "single", "add", "x"), ("liar", "s2", "factual", "the run passed", "u3", "single", "add", "x"),
        ("a", "s1", "factual", "port is 1", "u4", "single", "add", "1"), ("b", "s3", "factual", "port is 2", "u4", "single", "supersede", "2"), ("c", "s3", "factual", "12 tests passed", "u4", "single", "add", "1"),
        ("d", "s3", "factual", "port is 3", "u4", "multi", "add", "3"), ("e", "s3", "summary", "port is 4", "u4", "single", "add", "4"), ("f", "s3", "factual", "port is 5", "u4", "single", "enrich", "5"), ("g", "s3", "factual", "fixed", "u5", "single", "add", "1"),
    ]
    batch = spark.createDataFrame([(*r[:4], "scope", r[4], "p", *r[5:]) for r in rows], "candidate_id string, session_id string, memory_type string, content string, scope_id string, subject_key string, predicate_key string, cardinality string, action string, value string")
    sources = spark.createDataFrame([("s1", f"User said: {long} and more"), ("s2", "it failed with an error"), ("s3", "failed at first"), ("s3", "and was fixed")], "session_id string, content string")
    got = {r["candidate_id"]: r["reasons"] for r in digest.quarantine(batch, sources).collect()}
    one = "same_batch_single_value_conflict"
    assert got == {"copy": ["source_transcript_copy"], "liar": ["outcome_contradicts_source"], "a": [one], "b": [one], "c": [one, "test_run_snapshot"]}


def merged(a, b):
    key = lambda s: re.sub(r"[^a-z0-9\u4e00-\u9fff]+", "", s.lower())
    kept = []
    for origin, text in (("a", a), ("b", b)):
        for piece in re.split(r"\s*\n\s*§\s*\n\s*|\s+/\s+", text or ""):
            k = key(piece.strip())
            if not k:
                continue
            for i, (t, old, who) in enumerate(kept):
                if k == old or (len(k) >= 12 and k in old):
                    kept[i] = (t, old, who | {origin})
                    break
                if len(old) >= 12 and old in k:
                    kept[i] = (piece.strip(), k, who | {origin})
                    break
            else:
                kept.append((piece.strip(), k, {origin}))
    return "\n§\n".join(t for t, _, _ in kept), [sorted(w) for _, _, w in kept]


def test_merged_texts(spark):
    rnd = random.Random(8)
    said = ["The gate depends on the cache", "the gate depends on the cache.", "Short", "short!", "The gate depends on the cache and the queue", "我的服务器运行在北京朝阳区的机房", "服务器运行在北京朝阳区的机房", "??", "The queue", "It says: the gate depends on the cache and the queue of Tuesday"]
    rows = [(f"m{k}", rnd.choice(["\n§\n", " / "]).join(rnd.choice(said) for _ in range(rnd.randrange(0, 6))) or None) for k in range(80)]
    pairs = [(f"m{k}", f"m{rnd.randrange(80)}") for k in range(80)] + [("m1", "m1")]
    got = govern.merged_texts(spark.createDataFrame(rows, "id string, content string"), spark.createDataFrame(pairs, "a string, b string")).collect()
    text = dict(rows)
    assert len(got) == len(pairs)
    for r in got:
        want, origins = merged(text[r["a"]], text[r["b"]])
        assert (r["content"], r["segments"]) == (want, len(origins))
        assert r["a"] == r["b"] or r["origins"] == [sorted({"a": r["a"], "b": r["b"]}[w] for w in o) for o in origins]
