"""Keyed state that survives a restart, against plain folds; and interval joins against all pairs."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from palimpsest.operators import digest, temporal
from palimpsest.streaming import incremental, stateful
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def stopped_and_resumed(spark, tmp_path, rows, files, run):
    """Read ``rows`` file by file; the sink fails in the second batch, and a new query goes on from the checkpoint."""
    stateful.use_state_store(spark)
    for k in range(files):
        rows.where(F.col("file") == k).drop("file").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        time.sleep(0.05)  # files are read in the order of their times
    schema = rows.drop("file").schema
    read = lambda: run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    write = incremental.kept(f"{tmp_path}/out")

    def fails(batch, number):
        write(batch, number)  # written, but the batch is not committed: it is run again
        if number == 1:
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped|FOREACH_BATCH"):
        incremental.drain(read(), fails, f"{tmp_path}/cp").awaitTermination()
    done = {r["batch"] for r in spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().collect()}
    assert max(done) <= 1
    incremental.drain(read(), write, f"{tmp_path}/cp").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").drop("batch")


def entries(spark):
    rnd = random.Random(4)
    topics = [f"word{c}" for c in "abcdefgh"]
    rows = [(f"s{s}", t, rnd.choice(["user", "assistant"]), " ".join(["the", "of", *rnd.sample(topics, rnd.choice([0, 1, 1, 2]))]) + f" {t}") for s in range(12) for t in range(30)]
    return rows, spark.createDataFrame(rows, "session_id string, turn_number int, role string, content string")


def folded(rows):
    """Segments of sessions by the plainest fold."""
    out, state = [], {}
    for session, turn, role, content in sorted(rows):
        segment, topic = state.get(session, (0, set()))
        now = {w for w in content.split() if len(w) >= 4}
        if role == "user" and topic and now and not topic & now:
            segment, topic = segment + 1, set()
        state[session] = segment, topic | now
        out.append((session, turn, role, content, segment))
    return sorted(out)


def test_segments(spark, tmp_path):
    rows, frame = entries(spark)
    assert sorted(map(tuple, digest.segments(frame).collect())) == folded(rows)
    stream = frame.withColumn("words", digest.topic_words("content")).withColumn("file", F.floor(F.col("turn_number") / 8).cast("int"))
    got = stopped_and_resumed(spark, tmp_path, stream, 4, stateful.streamed_segments)
    assert sorted(map(tuple, got.collect())) == folded(rows)


def test_leases(spark, tmp_path):
    rnd = random.Random(6)
    rows = []
    for n in range(600):
        kind = rnd.choice(["enqueue", "claim", "claim", "complete", "fail", "fail"])
        rows.append((f"k{rnd.randrange(12)}", n, T0 + timedelta(minutes=n), kind, f"w{rnd.randrange(2)}", n // 200))
    rows += [("lost", 600, T0, "enqueue", "w0", 0), ("lost", 601, T0 + timedelta(minutes=1), "claim", "w0", 0)]  # and never heard of again
    rules = {"lease": timedelta(minutes=30), "backoff": timedelta(minutes=20), "most": 3}
    state, want = {}, []
    for key, n, at, kind, worker, _ in rows:
        s = state.get(key)
        if kind == "enqueue" and s is None:
            s = {"status": "pending", "attempts": 0, "worker": "", "free": at}
        elif kind == "claim" and s and s["status"] in ("pending", "retry", "processing") and s["free"] <= at:
            s = {"status": "processing", "attempts": s["attempts"] + 1, "worker": worker, "free": at + rules["lease"]}
        elif kind in ("complete", "fail") and s and s["status"] == "processing" and s["worker"] == worker:
            status = "completed" if kind == "complete" else "dead_letter" if s["attempts"] >= 3 else "retry"
            s = s | {"status": status, "worker": "", "free": at + rules["backoff"]}
        else:
            continue
        state[key] = s
        want.append((key, n, s["status"], s["attempts"], s["worker"]))
    frame = spark.createDataFrame(rows, "key string, n long, at timestamp, kind string, worker string, file int")
    got = stopped_and_resumed(spark, tmp_path, frame, 3, lambda s: stateful.streamed_leases(s, "0 seconds", **rules)).cache()
    assert sorted(tuple(r)[:2] + tuple(r)[3:] for r in got.where("n >= 0").collect()) == sorted(want)
    assert {"processing", "retry", "dead_letter", "completed"} <= {w[2] for w in want}
    late = {(r["key"], r["at"].replace(tzinfo=timezone.utc)) for r in got.where("status = 'lease_expired'").collect()}  # told by timers
    assert ("lost", T0 + timedelta(minutes=31)) in late
    assert late <= {(w[0], T0 + timedelta(minutes=1 if w[1] == 601 else w[1]) + rules["lease"]) for w in want if w[2] == "processing"}


def test_gate(spark, tmp_path):
    rows = [(f"s{n % 3}", n, T0 + timedelta(minutes=n * n % 977 + n * 7), n // 100) for n in range(300)]
    rows = [(s, n, at, f) for s, n, at, f in sorted(rows, key=lambda r: r[2])]
    rows = [(s, n, at, k // 100) for k, (s, n, at, _) in enumerate(rows)]
    want, state = [], {}
    for s, n, at, _ in rows:
        run, began, waits = state.get(s, (0, None, 0))
        waits += 1
        if began is None or at - began >= timedelta(hours=3):
            run, began = run + 1, at
            want.append((s, run, waits, n))
            waits = 0
        state[s] = run, began, waits
    frame = spark.createDataFrame(rows, "scope_id string, n long, at timestamp, file int")
    got = stopped_and_resumed(spark, tmp_path, frame, 3, lambda s: stateful.streamed_gate(s, timedelta(hours=3)))
    assert sorted((r["scope_id"], r["run"], r["n"], r["last"]) for r in got.collect()) == sorted(want)


def claims(spark, rows):
    frame = spark.createDataFrame(rows, "claim_id string, scope_id string, subject_key string, predicate_key string, valid_from long, valid_to long")
    return frame.withColumns({c: F.timestamp_seconds(c) for c in ("valid_from", "valid_to")})


def test_every_pair_once(spark):
    """Open and empty intervals, equal instants, one slot with most claims."""
    rnd = random.Random(9)
    rows = []
    for i in range(400):
        a = rnd.choice([None, *range(60)])
        b = None if rnd.random() < 0.1 else (a or 0) + rnd.choice([0, 1, 2, 5, 40])
        rows.append((f"c{i:03}", "s", "u", "hot" if i % 3 else f"p{i % 5}", a, b))
    low, high = float("-inf"), float("inf")
    at = lambda x, none: none if x is None else x
    want = {(x[0], y[0]) for x in rows for y in rows if x[1:4] == y[1:4] and x[0] != y[0] and (at(x[4], low), x[0]) < (at(y[4], low), y[0]) and at(x[5], high) > at(y[4], low)}
    got = [(r["a"], r["b"]) for r in temporal.overlapping_pairs(claims(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def hot_slot(spark, n):
    rows = spark.range(n).selectExpr("CAST(id AS STRING) AS claim_id", "'s' AS scope_id", "'u' AS subject_key", "'p' AS predicate_key", "timestamp_seconds(id * 60) AS valid_from", "timestamp_seconds(id * 60 + 90) AS valid_to")
    return rows


def test_one_hot_slot_takes_linear_time(spark):
    """200,000 claims of one slot: each overlaps the next, and newcomers are checked in one pass."""
    rows = hot_slot(spark, 200_000)
    assert temporal.overlapping_pairs(rows).count() == 199_999
    began = time.perf_counter()
    new = rows.withColumns({"claim_id": F.concat(F.lit("n"), "claim_id"), "valid_from": F.col("valid_from") + F.expr("INTERVAL 400 DAYS"), "valid_to": F.col("valid_to") + F.expr("INTERVAL 400 DAYS")})
    assert temporal.insert_checked(rows, new).where("rejected").count() == 0
    assert time.perf_counter() - began < 60


def test_trust_of_a_hot_key(spark):
    """Half of 100,000 steps are one key's: blocks of it are folded apart, in order."""
    from palimpsest.operators import govern

    rows = spark.range(100_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('k', id % 997) END AS u", "timestamp_seconds(id * 37 % 100003) AS t", "id AS n", "CASE id % 3 WHEN 0 THEN -0.12D ELSE 0.08D END AS step")
    got = {r["u"]: r["trust"] for r in govern.trust(rows, "u", ["t", "n"]).collect()}
    want = {}
    for r in rows.orderBy("t", "n").collect():
        want[r["u"]] = min(1.0, max(0.0, want.get(r["u"], 0.5) + r["step"]))
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in want)
