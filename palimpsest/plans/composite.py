"""Composite queries: typed relations, scope isolation, fact search, inspection, generations, audits and digest streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy, text
from ..operators import digest, recall, scan, temporal
from ..streaming import incremental
from . import fixtures as fx
from ..sources.scratch import folder as scratch
from .recalling import tok
from .registry import register
from .scans import LIFE, VISIBLE

_CLOSE = "CASE WHEN regexp_matches(tail, '(?i)\\b(failed|failure|error|broken|blocked)\\b') THEN 'failed' WHEN regexp_matches(tail, '(?i)\\b(maybe|unsure|unclear|not sure|might)\\b') THEN 'uncertain' WHEN regexp_matches(tail, '(?i)\\b(done|completed|finished|fixed|deployed|resolved)\\b') THEN 'success' WHEN regexp_matches(body, '(?i)\\b(failed|failure|error|broken|blocked)\\b') THEN 'uncertain' ELSE 'unknown' END"


@register("q7_fact_search", fx.with_("claims") + ", c AS (SELECT *, lower(subject_key || ' ' || predicate_key || ' ' || value) AS t FROM claims WHERE status = 'current' AND retired_at IS NULL) SELECT claim_id, round((CASE WHEN contains(t, 'click') THEN 5 ELSE 0 END + CASE WHEN contains(t, 'user') THEN 4 ELSE 0 END) / 9e0, 6) AS score FROM c WHERE contains(t, 'click') OR contains(t, 'user') ORDER BY score DESC, confidence DESC, subject_key, claim_id LIMIT 40")
def q7(spark, d):
    c = temporal.current(fx.claims(spark, d), "2024-03-01 00:00:00").withColumn("t", F.concat_ws(" ", "subject_key", "predicate_key", "value"))
    c = c.withColumn("score", F.round(text.weighted_overlap(F.lit("the click of the user"), F.col("t")), 6)).where("score > 0")
    return c.orderBy(F.desc("score"), F.desc("confidence"), "subject_key", "claim_id").limit(40).select("claim_id", "score")


@register("q10_entity_probe", fx.with_("memories", "entities") + f"SELECT m.id FROM memories m JOIN entities e ON e.memory_id = m.id WHERE e.entity = 'tion' AND {VISIBLE} ORDER BY CASE target WHEN 'user' THEN 0 WHEN 'memory' THEN 1 WHEN 'project' THEN 2 ELSE 3 END, updated_at DESC, m.id LIMIT 25")
def q10(spark, d):
    e = fx.entities(spark, d).where("entity = 'tion'").select(F.col("memory_id").alias("id"))
    m = fx.memories(spark, d).where(policy.ordinary_visible()).join(e, "id", "left_semi")
    return m.orderBy(policy.mapped(F.col("target"), {"user": 0, "memory": 1, "project": 2}, 3), F.desc("updated_at"), "id").limit(25).select("id")


@register("k9_audit_events", fx.with_("memories") + f"SELECT id AS target_id, {LIFE} AS before, 'archived' AS after, sha256(id || '|' || {LIFE}) AS event_key FROM memories WHERE {LIFE} = 'obsolete'")
def k9(spark, d):
    state = policy.lifecycle()
    return fx.memories(spark, d).where(state == "obsolete").select(F.col("id").alias("target_id"), state.alias("before"), F.lit("archived").alias("after"), F.sha2(F.concat_ws("|", "id", state), 256).alias("event_key"))


@register("k16_index_rebuild", fx.with_("memories") + f"SELECT term, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({tok('content')}) AS term FROM memories) GROUP BY 1, 2) GROUP BY term HAVING count(*) > 20")
def k16(spark, d):
    p = recall.postings(fx.memories(spark, d)).where("term <> ''")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("occurrences")).where("postings > 20")


@register("st9_streamed_digest", fx.with_("journal") + ", s AS (SELECT scope_id, trim(unnest(regexp_split_to_array(content, '[.!?。！？；;\\n]+')), ' ') AS c FROM journal WHERE role = 'user') SELECT DISTINCT scope_id, regexp_replace(lower(trim(c)), '\\s+', ' ', 'g') AS dedup_key FROM s WHERE length(c) BETWEEN 20 AND 400")
def st9(spark, d):
    path = scratch(spark)
    j = fx.journal(spark, d)
    j.repartition(5, "session_id").write.parquet(f"{path}/in")

    def each(batch, number):
        digest.candidates(batch).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream = incremental.file_stream(spark, f"{path}/in", j.schema, 2)
    incremental.drain(stream, each, f"{path}/cp").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("scope_id", "dedup_key").distinct()


@register("m12_graph_repair", fx.with_("memories", "relations") + "SELECT source_memory_id, target_memory_id, relation_type FROM relations WHERE source_memory_id = target_memory_id OR source_memory_id NOT IN (SELECT id FROM memories WHERE target <> 'general') OR target_memory_id NOT IN (SELECT id FROM memories WHERE target <> 'general')")
def m12(spark, d):
    ids = fx.memories(spark, d).where("target <> 'general'").select("id")
    r = fx.relations(spark, d)
    good = r.where("source_memory_id <> target_memory_id").join(ids, r.source_memory_id == ids.id, "left_semi").join(ids.withColumnRenamed("id", "t"), F.col("target_memory_id") == F.col("t"), "left_semi")
    key = ["source_memory_id", "target_memory_id", "relation_type"]
    return r.select(*key).join(good.select(*key), key, "left_anti")


@register("m18_nightly_duplicates", fx.with_("memories") + f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY target, dedup_key ORDER BY updated_at DESC, created_at DESC, id DESC) AS r FROM memories WHERE {VISIBLE}) WHERE r > 1")
def m18(spark, d):
    from ..operators import reports

    return reports.duplicates(fx.memories(spark, d).where(policy.ordinary_visible()), ["target", "dedup_key"]).where("place > 1").select("id")


@register("m28_doctor_summary", fx.with_("memories", "journal", "outbox") + f"SELECT 'memories' AS part, count(*) AS rows, count(CASE WHEN NOT {VISIBLE} THEN 1 END) AS flagged FROM memories UNION ALL SELECT 'journal', count(*), count(CASE WHEN processed_run_id IS NULL THEN 1 END) FROM journal UNION ALL SELECT 'outbox', count(*), count(CASE WHEN status = 'dead' THEN 1 END) FROM outbox")
def m28(spark, d):
    part = lambda name, rows, bad: rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("flagged")).select(F.lit(name).alias("part"), "rows", "flagged")
    out = part("memories", fx.memories(spark, d), ~policy.ordinary_visible())
    out = out.unionByName(part("journal", fx.journal(spark, d), F.col("processed_run_id").isNull()))
    return out.unionByName(part("outbox", fx.outbox(spark, d), F.col("status") == "dead"))
