"""Queries of sources, digests, identity and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import digest
from ..sources import files
from ..sources.scratch import folder as scratch
from ..streaming import incremental
from . import fixtures as fx
from .registry import register
from .scans import VISIBLE


@register("k5_jsonl_export", fx.with_("memories") + f"SELECT id, target, content FROM memories WHERE {VISIBLE}")
def k5(spark, d):
    from ..functions import policy

    path = scratch(spark) + "/export"
    files.export(fx.memories(spark, d).where(policy.ordinary_visible()).select("id", "target", "content"), path)
    return spark.read.schema("id string, target string, content string").json(path)


@register("k15_import_new", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lang, text HAVING NOT bool_or(doc_id % 5 = 0)")
def k15(spark, d):
    rows = files.fingerprinted(fx.read(spark, d, "documents"), "lang", "text")
    ledger = rows.where("doc_id % 5 = 0")
    first = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    return files.import_new(first, ledger).select("doc_id")


@register("q22_digest_candidates", fx.with_("journal") + ", s AS (SELECT scope_id, session_id, trim(unnest(regexp_split_to_array(content, '[.!?。！？；;\\n]+')), ' ') AS c FROM journal WHERE role = 'user') SELECT scope_id, dedup_key, min(session_id) AS session_id FROM (SELECT scope_id, session_id, regexp_replace(lower(trim(c)), '\\s+', ' ', 'g') AS dedup_key FROM s WHERE length(c) BETWEEN 20 AND 400) GROUP BY 1, 2")
def q22(spark, d):
    return digest.candidates(fx.journal(spark, d)).select("scope_id", "dedup_key", "session_id")


@register("o11_evidence_budget", fx.with_("memories") + "SELECT scope_id, id FROM (SELECT scope_id, id, row_number() OVER (PARTITION BY scope_id ORDER BY CAST(id AS BIGINT)) AS n, sum(length(left(content, 100))) OVER (PARTITION BY scope_id ORDER BY CAST(id AS BIGINT) ROWS UNBOUNDED PRECEDING) AS used FROM memories WHERE length(content) >= 100) WHERE n <= 8 AND used <= 1000")
def o11(spark, d):
    m = fx.memories(spark, d).where(F.char_length("content") >= 100).withColumn("n", F.col("id").cast("long"))
    return digest.budgeted(m, "scope_id", "n", 8, 1000, 100)


@register("n29_fact_fingerprints", "SELECT n_nationkey, sha256('[\"' || lower(n_name) || '\",\"region\",\"' || lower(r_name) || '\"]') AS fingerprint FROM nation JOIN region ON n_regionkey = r_regionkey")
def n29(spark, d):
    j = fx.read(spark, d, "nation").join(fx.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_nationkey", identity.fingerprint(identity.fold("n_name"), F.lit("region"), identity.fold("r_name")).alias("fingerprint"))


@register("st1_event_dedup", fx.with_("outbox") + "SELECT DISTINCT event_key FROM outbox")
def st1(spark, d):
    return fx.outbox(spark, d).dropDuplicates(["event_key"]).select("event_key")


@register("st3_streamed_newest_wins", fx.with_("outbox") + "SELECT event_key, id FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY id DESC) AS n FROM outbox) WHERE n = 1 AND operation <> 'delete'")
def st3s(spark, d):
    path = scratch(spark)
    fx.outbox(spark, d).repartition(6, "id").write.parquet(f"{path}/in")
    stream = incremental.file_stream(spark, f"{path}/in", fx.outbox(spark, d).schema, 2)
    incremental.drain(stream, incremental.newest_wins(f"{path}/out", "event_key", "id"), f"{path}/cp").awaitTermination()
    return incremental.current(spark, f"{path}/out", "event_key", "id").select("event_key", "id")


@register("st6_streamed_frequencies", fx.with_("memories", "entities") + "SELECT scope_id, entity, count(*) AS n FROM entities WHERE CAST(memory_id AS BIGINT) % 4 <> 0 GROUP BY 1, 2")
def st6(spark, d):
    path = scratch(spark)
    e = fx.entities(spark, d).withColumn("delta", F.lit(1))
    gone = e.where("CAST(memory_id AS BIGINT) % 4 = 0").withColumn("delta", F.lit(-1))
    changes = e.unionByName(gone)
    changes.repartition(4, "memory_id").write.parquet(f"{path}/in")
    stream = incremental.file_stream(spark, f"{path}/in", changes.schema, 1)
    incremental.drain(stream, incremental.frequency_deltas(f"{path}/out", ["scope_id", "entity"]), f"{path}/cp").awaitTermination()
    return incremental.frequencies(spark, f"{path}/out", ["scope_id", "entity"])


@register("st10_retention", fx.with_("journal") + "SELECT session_id, turn_number, role FROM journal WHERE processed_run_id IS NULL OR CAST(session_id AS BIGINT) >= 50")
def st10(spark, d):
    return fx.journal(spark, d).where("processed_run_id IS NULL OR CAST(session_id AS BIGINT) >= 50").select("session_id", "turn_number", "role")


@register("ext_tumbling_windows", "SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def ext_windows(spark, d):
    e = fx.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.windowed_counts(e, "ts", "1 day", None, "event_type").select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


@register("ext_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6' HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM s GROUP BY user_id, s")
def ext_sessions(spark, d):
    e = fx.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.sessions(e, "ts", "6 hours", "user_id").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")


@register("p20_context_lines", fx.with_("memories") + "SELECT scope_id, id FROM (SELECT scope_id, id, sum(length(regexp_replace(trim(summary), '\\s+', ' ', 'g')) + 1) OVER (PARTITION BY scope_id ORDER BY CAST(id AS BIGINT) ROWS UNBOUNDED PRECEDING) AS used FROM memories) WHERE used <= 900")
def p20c(spark, d):
    from ..operators import scan

    m = fx.memories(spark, d).withColumn("n", F.col("id").cast("long")).withColumn("line", text.compact("summary", 10_000))
    return scan.fits_budget(m, "scope_id", "n", F.char_length("line") + 1, 900).select("scope_id", "id")
