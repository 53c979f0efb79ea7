"""Queries of scans, sinks, predicates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy, text
from ..operators import scan
from ..sources import files
from . import fixtures as fx
from .registry import register

LIFE = "lower(coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.lifecycle') END, ''))"
HIDDEN = "('archived','obsolete','rejected','superseded','candidate','scratch','in_progress')"
VISIBLE = f"({LIFE} NOT IN {HIDDEN} OR (target = 'general' AND {LIFE} = 'scratch'))"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@register("s1_scoped_scan", fx.with_("memories") + f"SELECT id, scope_id, target FROM memories WHERE scope_id IN ('src1', 'src7', 'src9') AND {VISIBLE}")
def s1(spark, d):
    return scan.scoped(fx.memories(spark, d), ["src1", "src7", "src9"]).select("id", "scope_id", "target")


@register("s2_newest_of_target", fx.with_("memories") + f"SELECT id, {TS.format('updated_at')} AS updated FROM memories WHERE target = 'ops' ORDER BY updated_at DESC, id LIMIT 20")
def s2(spark, d):
    return scan.newest(fx.memories(spark, d), 20, target="ops").select("id", stamp("updated_at").alias("updated"))


@register("s3_point_lookup", fx.with_("memories") + "SELECT id, target, source, length(content) AS n FROM memories WHERE id = '42'")
def s3(spark, d):
    return fx.memories(spark, d).where("id = '42'").select("id", "target", "source", F.char_length("content").cast("long").alias("n"))


@register("s6_journal_backlog", fx.with_("journal") + "SELECT session_id, turn_number, role FROM journal WHERE processed_run_id IS NULL AND role IN ('user','assistant','tool') AND session_id NOT IN ('1','2') ORDER BY CAST(session_id AS BIGINT), turn_number, role LIMIT 100")
def s6(spark, d):
    denied = spark.createDataFrame([("1",), ("2",)], "session_id string")
    rows = fx.journal(spark, d).where("processed_run_id IS NULL").where(F.col("role").isin("user", "assistant", "tool"))
    return rows.join(F.broadcast(denied), "session_id", "left_anti").orderBy(F.col("session_id").cast("long"), "turn_number", "role").limit(100).select("session_id", "turn_number", "role")


@register("s7_unprocessed_scopes", fx.with_("journal") + "SELECT scope_id, min(CAST(session_id AS BIGINT)) AS first_id, count(*) AS n FROM journal WHERE processed_run_id IS NULL GROUP BY scope_id")
def s7(spark, d):
    return fx.journal(spark, d).where("processed_run_id IS NULL").groupBy("scope_id").agg(F.min(F.col("session_id").cast("long")).alias("first_id"), F.count(F.lit(1)).alias("n"))


@register("s8_vector_scan", "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INTEGER) AS dimensions, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings WHERE label = 3")
def s8(spark, d):
    v = fx.vectors(spark, d).where("scope_id = 'label-3'")
    return v.select("id", F.size("vector").alias("dimensions"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@register("s9_keyset_page", fx.with_("memories") + "SELECT id FROM memories WHERE (updated_at > TIMESTAMP '2024-01-01 01:00:00' OR updated_at = TIMESTAMP '2024-01-01 01:00:00' AND id > '60') AND (updated_at < TIMESTAMP '2024-01-01 09:00:00' OR updated_at = TIMESTAMP '2024-01-01 09:00:00' AND id <= '9') ORDER BY updated_at, id LIMIT 250")
def s9(spark, d):
    return scan.page(fx.memories(spark, d), ("2024-01-01 01:00:00", "60"), ("2024-01-01 09:00:00", "9"), 250).select("id")


@register("s10_untracked_inventory", fx.with_("memories", "entities") + "SELECT m.id FROM memories m WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.memory_id = m.id AND e.entity = 'tion')")
def s10(spark, d):
    return scan.missing(fx.memories(spark, d), fx.entities(spark, d).where("entity = 'tion'").select(F.col("memory_id").alias("id")), "id").select("id")


@register("s11_import_plan", "SELECT min(doc_id) AS first_id, sha1(concat_ws(chr(10), lang, source, text)) AS fingerprint, count(*) AS n FROM documents GROUP BY 2")
def s11(spark, d):
    rows = fx.read(spark, d, "documents").withColumn("fingerprint", F.sha1(F.concat_ws("\n", "lang", "source", "text")))
    return rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


_FOREIGN = (
    "SELECT doc_id AS id, CASE WHEN doc_id % 31 = 0 THEN ' ' WHEN doc_id % 29 = 0 THEN concat('User: hello', chr(10), 'Assistant: ', text) WHEN doc_id % 23 = 0 THEN concat(text, ' password = x', CAST(doc_id AS {s})) ELSE text END AS text, CASE WHEN doc_id % 9 = 0 THEN '' ELSE source END AS scope, "
    "CASE doc_id % 7 WHEN 0 THEN 'Ops ' WHEN 1 THEN 'secretive' WHEN 2 THEN NULL ELSE 'memory' END AS category, CAST(doc_id * 60 AS {s}) AS timestamp, CASE WHEN doc_id % 17 = 0 THEN '{{\"from\": \"/home/user/notes\"}}' END AS metadata FROM documents"
)


@register("s11_import_mapping", f"WITH f AS ({_FOREIGN.format(s='VARCHAR')}), m AS (SELECT CAST(id AS VARCHAR) AS row_id, trim(text) AS content, CASE WHEN scope = '' THEN 'unknown' ELSE scope END AS raw_scope, coalesce(lower(trim(category)), 'memory') AS target, timestamp, coalesce(metadata, '') AS metadata FROM f), "
    "p AS (SELECT *, sha1(concat_ws(chr(10), row_id, raw_scope, target, content, timestamp, metadata)) AS fingerprint FROM m) "
    "SELECT row_id, CASE WHEN content = '' THEN 'empty' WHEN target NOT IN ('user', 'memory', 'project', 'ops', 'general') THEN 'target_not_allowed' WHEN CAST(row_id AS BIGINT) % 29 = 0 THEN 'raw_transcript' WHEN CAST(row_id AS BIGINT) % 13 = 0 THEN 'already_imported' ELSE 'importable' END AS outcome, 'imported:' || fingerprint AS id, 'old|' || raw_scope AS scope_id, target, "
    "concat_ws(',', CASE WHEN regexp_matches(content || chr(10) || metadata, '(?i)(?:api[_-]?key|token|secret|password|passwd|private[_-]?key)\s*[:=]\s*[^\s]+') THEN 'secret_like' END, CASE WHEN regexp_matches(content || chr(10) || metadata, '/home/') THEN 'path_like' END) AS findings FROM p")
def s11m(spark, d):
    fx.read(spark, d, "documents").createOrReplaceTempView("foreign_documents")
    rows = spark.sql(_FOREIGN.format(s="STRING").replace("FROM documents", "FROM foreign_documents"))
    none = spark.createDataFrame([], "fingerprint string")
    ledger = files.import_plan(rows, none, "old").where("CAST(row_id AS BIGINT) % 13 = 0").select("fingerprint")
    return files.import_plan(rows, ledger, "old").select("row_id", "outcome", "id", "scope_id", "target", F.array_join("findings", ",").alias("findings"))


_BATCH = "SELECT id || '-new' AS id, scope_id, target, dedup_key, doc FROM (SELECT *, CAST(id AS BIGINT) AS doc FROM memories) WHERE doc % 3 = 0"


@register("k1_insert_new", fx.with_("memories") + f"SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY scope_id, target, dedup_key ORDER BY id) AS n FROM ({_BATCH})) b WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM memories m WHERE m.scope_id = b.scope_id AND m.target = b.target AND m.dedup_key = b.dedup_key AND {VISIBLE})")
def k1(spark, d):
    state = fx.memories(spark, d)
    batch = state.where(F.col("id").cast("long") % 3 == 0).withColumn("id", F.concat("id", F.lit("-new")))
    return scan.insert_new(state, batch, ["scope_id", "target", "dedup_key"], F.col("id")).select("id")


@register("k6_external_export", fx.with_("memories") + f"SELECT id, scope_id, target, {LIFE} AS lifecycle, CASE WHEN json_valid(metadata) THEN CAST(json_extract_string(metadata, '$.confidence') AS DOUBLE) END AS confidence, sha256(content) AS content_hash FROM memories WHERE {LIFE} NOT IN {HIDDEN} AND target <> 'general' AND NOT regexp_matches(content, '(?i)(api[_-]?key|token|secret|password|passwd|private[_-]?key)\\s*[:=]\\s*[^\\s]+')")
def k6(spark, d):
    m = fx.memories(spark, d).where(~policy.lifecycle().isin(*policy.ORDINARY_HIDDEN)).where("target <> 'general'").where(~F.col("content").rlike(text.SECRET))
    return m.select("id", "scope_id", "target", policy.lifecycle().alias("lifecycle"), policy.json_text("metadata", "$.confidence").cast("double").alias("confidence"), F.sha2("content", 256).alias("content_hash"))


@register("k8_journal_chunks")
def k8(spark, d):
    rows = fx.journal(spark, d).select("session_id", "turn_number", "role", F.posexplode(scan.chunks(F.col("content"), 2000)).alias("part", "content"))
    return rows.withColumn("content_hash", F.sha2("content", 256)).dropDuplicates(["session_id", "turn_number", "role", "content_hash"])


@register("k10_new_relations", fx.with_("memories", "relations") + "SELECT source_memory_id, target_memory_id, relation_type FROM relations r WHERE source_memory_id <> target_memory_id AND relation_type IN ('same_topic','supersedes','depends_on','owned_by','affects','invalidates') AND source_memory_id IN (SELECT id FROM memories) AND target_memory_id IN (SELECT id FROM memories)")
def k10(spark, d):
    ids = fx.memories(spark, d).select("id")
    r = fx.relations(spark, d).where("source_memory_id <> target_memory_id").where(F.col("relation_type").isin("same_topic", "supersedes", "depends_on", "owned_by", "affects", "invalidates"))
    for end in ("source_memory_id", "target_memory_id"):
        r = r.join(ids, r[end] == ids.id, "left_semi")
    return r.select("source_memory_id", "target_memory_id", "relation_type")


@register("p1_ordinary_visible", fx.with_("memories") + f"SELECT target, count(*) AS n FROM memories WHERE {VISIBLE} GROUP BY target")
def p1(spark, d):
    return fx.memories(spark, d).where(policy.ordinary_visible()).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@register("p2_durable_visible", fx.with_("memories") + f"SELECT id, {LIFE} AS lifecycle FROM memories WHERE {LIFE} NOT IN ('archived','obsolete','rejected','superseded')")
def p2(spark, d):
    return fx.memories(spark, d).where(policy.durable_visible()).select("id", policy.lifecycle().alias("lifecycle"))


@register("p3_profile_visible", fx.with_("memories") + f"SELECT id FROM memories WHERE {LIFE} IN ('', 'promoted') AND target <> 'general'")
def p3(spark, d):
    return fx.memories(spark, d).where(policy.profile_visible()).where("target <> 'general'").select("id")


@register("p5_current_claims", fx.with_("claims") + "SELECT claim_id, value FROM claims WHERE status = 'current' AND retired_at IS NULL AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-01-28 00:00:00') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-28 00:00:00')")
def p5(spark, d):
    return fx.claims(spark, d).where(policy.current_claim(F.lit("2024-01-28 00:00:00").cast("timestamp"))).select("claim_id", "value")


@register("p6_valid_at", fx.with_("claims") + "SELECT claim_id FROM claims WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-01-15 12:00:00') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 12:00:00')")
def p6(spark, d):
    return fx.claims(spark, d).where(policy.valid_at(F.lit("2024-01-15 12:00:00").cast("timestamp"))).select("claim_id")


@register("p14_skip_retrieval", fx.with_("queries") + "SELECT query_id, query = '' OR length(query) < 40 AS skipped FROM queries")
def p14(spark, d):
    return fx.queries(spark, d).select("query_id", text.skip_retrieval("query", 40).alias("skipped"))


@register("p15_capture_gate", "SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN length(text) > 4000 THEN 'too_long' WHEN regexp_matches(text, '(?i)(api[_-]?key|token|secret|password|passwd|private[_-]?key)\\s*[:=]\\s*[^\\s]+') THEN 'secret' ELSE 'allowed' END AS reason FROM documents")
def p15(spark, d):
    t = F.trim("text")
    reason = F.when(t == "", "empty").when(F.char_length("text") > 4000, "too_long").when(F.col("text").rlike(text.SECRET), "secret").otherwise("allowed")
    return fx.read(spark, d, "documents").select("doc_id", reason.alias("reason"))


@register("p16_source_isolation", fx.with_("journal") + "SELECT session_id, turn_number, role FROM journal WHERE scope_id NOT IN ('scope-1', 'scope-3')")
def p16(spark, d):
    return fx.journal(spark, d).where(~F.col("scope_id").isin("scope-1", "scope-3")).select("session_id", "turn_number", "role")


@register("p18_row_payload", fx.with_("memories") + "SELECT id, target, CASE WHEN length(regexp_replace(trim(content), '\\s+', ' ', 'g')) <= 80 THEN regexp_replace(trim(content), '\\s+', ' ', 'g') ELSE rtrim(left(regexp_replace(trim(content), '\\s+', ' ', 'g'), 79)) || '…' END AS preview FROM memories")
def p18(spark, d):
    return fx.memories(spark, d).select("id", "target", text.compact("content", 80).alias("preview"))


@register("p19_recently_recalled", fx.with_("memories") + "SELECT id FROM memories m LEFT JOIN (SELECT doc_id, doc_id % 20 AS turn FROM documents WHERE doc_id % 2 = 0) s ON m.id = CAST(s.doc_id AS VARCHAR) WHERE turn IS NULL OR 20 - turn >= 8")
def p19(spark, d):
    seen = fx.read(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 20).alias("turn"))
    return fx.memories(spark, d).join(seen, "id", "left").where("turn IS NULL OR 20 - turn >= 8").select("id")


@register("p20_budgeted_prefix", fx.with_("memories") + "SELECT id, used FROM (SELECT id, CAST(sum(length(summary)) OVER (PARTITION BY scope_id ORDER BY CAST(id AS BIGINT) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM memories) WHERE used <= 1600")
def p20(spark, d):
    m = fx.memories(spark, d).withColumn("n", F.col("id").cast("long"))
    return scan.fits_budget(m, "scope_id", "n", F.char_length("summary").cast("long"), 1600).select("id", "used")


@register("x1_relation_endpoints", fx.with_("relations") + "SELECT source_memory_id AS id FROM relations UNION SELECT target_memory_id FROM relations")
def x1(spark, d):
    r = fx.relations(spark, d)
    return r.select(F.col("source_memory_id").alias("id")).union(r.select("target_memory_id")).distinct()


@register("x2_set_difference", fx.with_("memories", "relations") + "SELECT side, count(*) AS n FROM ((SELECT 'left' AS side, id FROM memories EXCEPT SELECT 'left', source_memory_id FROM relations) UNION ALL (SELECT 'right', source_memory_id FROM relations EXCEPT SELECT 'right', id FROM memories)) GROUP BY side")
def x2(spark, d):
    a, b = fx.memories(spark, d).select("id"), fx.relations(spark, d).select(F.col("source_memory_id").alias("id"))
    both = a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@register("x3_number_generator", "SELECT CAST(doc_id AS VARCHAR) AS id, unnest(generate_series(0, CAST(doc_id % 7 AS INTEGER))) AS part FROM documents")
def x3(spark, d):
    return fx.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 7)).alias("part"))


@register("x5_dedup_across_channels", fx.with_("memories") + "SELECT k, min(id) AS id, count(*) AS n FROM (SELECT id, CASE WHEN source = 'builtin-curated' THEN 'curated:' || id WHEN target = 'general' THEN 'general:' || dedup_key ELSE 'durable:' || dedup_key END AS k FROM memories) GROUP BY k")
def x5(spark, d):
    key = F.when(F.col("source") == "builtin-curated", F.concat(F.lit("curated:"), "id")).when(F.col("target") == "general", F.concat(F.lit("general:"), "dedup_key")).otherwise(F.concat(F.lit("durable:"), "dedup_key"))
    return fx.memories(spark, d).groupBy(key.alias("k")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
