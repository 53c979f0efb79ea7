"""Queries of keyed state: each is a stream over files that is read to its end, and as a batch where there is a batch form."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import text
from ..operators import digest
from ..sources.scratch import folder as scratch
from ..streaming import incremental, stateful
from . import fixtures as fx
from .recalling import listed, tok
from .registry import register

#: Segments by a walk along each session; a word's last place and the place of the last word decide.
_SEGMENTS = (
    fx.with_("journal").replace("WITH ", "WITH RECURSIVE ", 1)
    + f", j AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_number, role, content) AS pos, list_filter(list_distinct({tok('content')}), lambda w: length(w) >= 4 AND NOT list_contains({listed((*text.SEMANTIC_STOPWORDS, *text.CJK_STOPWORDS))}, w)) AS words FROM journal), "
    "u AS (SELECT session_id, pos, unnest(words) AS word FROM j), l AS (SELECT session_id, pos, lag(pos) OVER (PARTITION BY session_id, word ORDER BY pos) AS last FROM u), s AS (SELECT session_id, pos, coalesce(max(last), 0) AS shared FROM l GROUP BY 1, 2), "
    "e AS (SELECT j.*, coalesce(max(CASE WHEN len(words) > 0 THEN j.pos END) OVER (PARTITION BY j.session_id ORDER BY j.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spoken, shared FROM j LEFT JOIN s USING (session_id, pos)), "
    "w AS (SELECT session_id, pos, CAST(1 AS BIGINT) AS start, 0 AS segment FROM e WHERE pos = 1 UNION ALL SELECT e.session_id, e.pos, CASE WHEN role = 'user' AND shared < start AND spoken >= start THEN e.pos ELSE start END, CASE WHEN role = 'user' AND shared < start AND spoken >= start THEN segment + 1 ELSE segment END FROM w JOIN e ON e.session_id = w.session_id AND e.pos = w.pos + 1) "
    "SELECT session_id, turn_number, role, content, segment FROM w JOIN e USING (session_id, pos)"
)


@register("w8_session_segments", _SEGMENTS)
def w8(spark, d):
    return digest.segments(fx.journal(spark, d))


def drained(spark, rows, key: str, order: str, run, files: int = 3):
    """``run`` over ``rows`` as a stream of files, each of which holds later rows of a key than the one before it."""
    stateful.use_state_store(spark)
    path = scratch(spark)
    cut = rows.select(F.percentile_approx(order, [k / files for k in range(1, files)], 1000).alias("at")).first()["at"]
    part = sum((F.col(order) > at).cast("int") for at in cut)
    for k in range(files):  # one after another, so that the file source reads them in this order
        rows.where(part == k).coalesce(1).write.parquet(f"{path}/in/part={k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    incremental.drain(run(stream), incremental.kept(f"{path}/out"), f"{path}/cp").awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


@register("w8_streamed_segments", _SEGMENTS)
def w8s(spark, d):
    rows = fx.journal(spark, d).select("session_id", "turn_number", "role", "content", digest.topic_words("content").alias("words"))
    return drained(spark, rows, "session_id", "turn_number", stateful.streamed_segments)


_KIND = "CASE WHEN event_id % 5 = 0 THEN 'claim' WHEN event_type = 'click' THEN 'claim' WHEN event_type = 'view' THEN 'enqueue' WHEN event_type = 'purchase' THEN 'complete' ELSE 'fail' END"
_WORKER = "concat('w', CAST(event_id % 2 AS STRING))"


@register("st2_streamed_leases", f"WITH RECURSIVE c AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS n, ts AS tm, {_KIND} AS kind, {_WORKER} AS worker, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), "
    "w AS (SELECT key, 0 AS i, CAST(-1 AS BIGINT) AS n, '' AS status, 0 AS attempts, '' AS worker, TIMESTAMP '1970-01-01 00:00:00' AS t, false AS did FROM (SELECT DISTINCT key FROM c) UNION ALL "
    "SELECT c.key, c.i, c.n, CASE d WHEN 'new' THEN 'pending' WHEN 'take' THEN 'processing' WHEN 'end' THEN 'completed' WHEN 'dead' THEN 'dead_letter' WHEN 'again' THEN 'retry' ELSE w.status END, CASE d WHEN 'take' THEN attempts + 1 ELSE attempts END, CASE WHEN d = 'take' THEN c.worker WHEN d = '' THEN w.worker ELSE '' END, "
    "CASE d WHEN 'new' THEN tm WHEN 'take' THEN tm + INTERVAL '6' HOUR WHEN 'again' THEN tm + INTERVAL '3' HOUR ELSE t END, d <> '' FROM w JOIN (SELECT *, '' AS x FROM c) c ON c.key = w.key AND c.i = w.i + 1, "
    "LATERAL (SELECT CASE WHEN kind = 'enqueue' AND w.status = '' THEN 'new' WHEN kind = 'claim' AND w.status IN ('pending', 'retry', 'processing') AND t <= tm THEN 'take' WHEN kind = 'complete' AND w.status = 'processing' AND w.worker = c.worker THEN 'end' WHEN kind = 'fail' AND w.status = 'processing' AND w.worker = c.worker THEN CASE WHEN attempts >= 3 THEN 'dead' ELSE 'again' END ELSE '' END AS d)) "
    "SELECT key, n, status, CAST(attempts AS INTEGER) AS attempts, worker FROM w WHERE did")
def st2s(spark, d):
    e = fx.read(spark, d, "events").selectExpr("CAST(user_id AS STRING) AS key", "event_id AS n", "CAST(ts AS TIMESTAMP) AS at", f"{_KIND} AS kind", f"{_WORKER} AS worker")
    rules = {"lease": timedelta(hours=6), "backoff": timedelta(hours=3), "most": 3}
    out = drained(spark, e.withColumn("s", F.col("at").cast("double")), "key", "s", lambda s: stateful.streamed_leases(s.drop("s"), **rules))
    return out.where("n >= 0").select("key", "n", "status", "attempts", "worker")


@register("st9_streamed_gate", "WITH RECURSIVE e AS (SELECT 'scope-' || CAST(user_id % 7 AS VARCHAR) AS scope_id, event_id AS n, ts AS tm, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS i FROM events), "
    "w AS (SELECT scope_id, i, n, tm, 1 AS run, CAST(0 AS BIGINT) AS before FROM e WHERE i = 1 UNION ALL SELECT scope_id, i, n, tm, run, before FROM (SELECT e.scope_id, e.i, e.n, e.tm, w.run + 1 AS run, w.i AS before, row_number() OVER (PARTITION BY e.scope_id ORDER BY e.i) AS r FROM w JOIN e ON e.scope_id = w.scope_id AND e.i > w.i AND e.tm - w.tm >= INTERVAL '1' DAY) WHERE r = 1) "
    "SELECT scope_id, run, i - before AS n, n AS last FROM w")
def st9s(spark, d):
    e = fx.read(spark, d, "events").selectExpr("concat('scope-', CAST(user_id % 7 AS STRING)) AS scope_id", "event_id AS n", "CAST(ts AS TIMESTAMP) AS at")
    out = drained(spark, e.withColumn("s", F.col("at").cast("double")), "scope_id", "s", lambda s: stateful.streamed_gate(s.drop("s"), timedelta(days=1)))
    return out.select("scope_id", "run", "n", "last")
