"""Queries of the graph, of joins over it, and of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy, text
from ..operators import graph, reports, scan
from . import fixtures as fx
from .recalling import norm
from .registry import register
from .scans import HIDDEN, LIFE, VISIBLE

ENDS = "(SELECT source_memory_id AS id, target_memory_id AS peer, relation_type, confidence, true AS outgoing FROM relations UNION ALL SELECT target_memory_id, source_memory_id, relation_type, confidence, false FROM relations)"


@register("j4_relation_evidence", fx.with_("memories", "relations") + f"SELECT e.id, relation_type, outgoing, count(*) AS n, round(sum(confidence), 4) AS confidence FROM {ENDS} e JOIN memories m ON m.id = e.peer WHERE {VISIBLE} GROUP BY 1, 2, 3")
def j4(spark, d):
    m = fx.memories(spark, d).where(policy.ordinary_visible()).select(F.col("id").alias("peer"))
    return graph.both_ends(fx.relations(spark, d)).join(m, "peer").groupBy("id", "relation_type", "outgoing").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@register("j5_peers_of_one", fx.with_("memories", "relations") + f"SELECT peer, relation_type, outgoing, target FROM {ENDS} e JOIN memories m ON m.id = e.peer WHERE e.id = '35'")
def j5(spark, d):
    m = fx.memories(spark, d).select(F.col("id").alias("peer"), "target")
    return graph.both_ends(fx.relations(spark, d)).where("id = '35'").join(m, "peer").select("peer", "relation_type", "outgoing", "target")


@register("j7_semi_join_scopes", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def j7(spark, d):
    c = fx.read(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    o = fx.read(spark, d, "orders")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey")


@register("j8_substring_semi_join", fx.with_("memories") + "SELECT id FROM memories WHERE contains(content, 'edtion') OR contains(content, 'thhaea') OR contains(content, 'enkeit')")
def j8(spark, d):
    terms = F.array(*map(F.lit, ["edtion", "thhaea", "enkeit"]))
    return fx.memories(spark, d).where(F.exists(terms, lambda t: F.contains(F.col("content"), t))).select("id")


@register("j9_anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def j9(spark, d):
    used = fx.read(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return scan.missing(fx.read(spark, d, "part"), used, "p_partkey").select("p_partkey")


@register("j14_related_entities", fx.with_("memories", "entities") + "SELECT entity, count(DISTINCT memory_id) AS n FROM entities WHERE memory_id IN (SELECT memory_id FROM entities WHERE entity = 'tion') AND entity <> 'tion' GROUP BY entity ORDER BY n DESC, entity LIMIT 20")
def j14(spark, d):
    return graph.related_entities(fx.entities(spark, d), "tion", 20)


@register("j12_similar_pairs", fx.with_("memories", "relations") + f", s AS ({norm('SELECT id, content AS body FROM memories')}), c AS (SELECT id, count(*) AS n FROM s GROUP BY id), p AS (SELECT a.id AS a, b.id AS b FROM memories a JOIN memories b ON a.scope_id = b.scope_id AND a.target = b.target AND a.id < b.id), cd AS (SELECT DISTINCT least(source_memory_id, target_memory_id) AS a, greatest(source_memory_id, target_memory_id) AS b FROM relations WHERE relation_type = 'contradicts'), i AS (SELECT p.a, p.b, CAST(count(*) AS DOUBLE) AS i FROM p ANTI JOIN cd USING (a, b) JOIN s x ON x.id = p.a JOIN s y ON y.id = p.b AND x.u = y.u GROUP BY 1, 2) SELECT a, b, round(greatest(i / (ca.n + cb.n - i), 0.82e0 * i / least(ca.n, cb.n)), 6) AS similarity FROM i JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE greatest(i / (ca.n + cb.n - i), 0.82e0 * i / least(ca.n, cb.n)) >= 0.6")
def j12(spark, d):
    bad = fx.relations(spark, d).where("relation_type = 'contradicts'").select(F.col("source_memory_id").alias("a"), F.col("target_memory_id").alias("b"))
    return graph.similar_pairs(fx.memories(spark, d), 0.6, contradictions=bad).select("a", "b", F.round("similarity", 6).alias("similarity"))


@register("a7_entity_frequency", fx.with_("memories", "entities") + ", n AS (SELECT scope_id, count(DISTINCT memory_id) AS n FROM entities GROUP BY 1), f AS (SELECT scope_id, entity, count(DISTINCT memory_id) AS df FROM entities GROUP BY 1, 2) SELECT scope_id, entity, df, CASE WHEN n >= 20 THEN CAST(greatest(12, ceil(n * 0.03e0)) AS BIGINT) END AS threshold, coalesce(df >= CASE WHEN n >= 20 THEN greatest(12, ceil(n * 0.03e0)) END, false) AS blocked FROM f JOIN n USING (scope_id)")
def a7(spark, d):
    return graph.entity_frequency(fx.entities(spark, d))


@register("q11_graph_distance", fx.with_("relations") + f", e AS (SELECT DISTINCT id, peer FROM {ENDS}), s AS (SELECT unnest(['3', '77']) AS seed), d0 AS (SELECT seed, seed AS id, 0 AS distance FROM s), d1 AS (SELECT DISTINCT seed, peer AS id, 1 AS distance FROM d0 JOIN e USING (id)), d2 AS (SELECT DISTINCT seed, peer AS id, 2 AS distance FROM d1 JOIN e USING (id)) SELECT seed, id, min(distance) AS distance, round(1e0 / (1 + min(distance)), 6) AS score FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY 1, 2")
def q11(spark, d):
    seeds = spark.sql("SELECT explode(array('3', '77')) AS id")
    return graph.distances(seeds, fx.relations(spark, d)).select("seed", "id", "distance", F.round("score", 6).alias("score"))


@register("n27_relation_bonus", fx.with_("relations") + f"SELECT id, round(greatest(-0.08e0, least(0.08e0, sum(confidence * CASE WHEN outgoing THEN CASE WHEN relation_type IN ('supersedes','supports','depends_on','affects','owned_by') THEN 0.04e0 WHEN relation_type = 'same_topic' THEN 0.01e0 ELSE 0e0 END ELSE CASE WHEN relation_type = 'supports' THEN 0.04e0 WHEN relation_type = 'same_topic' THEN 0.01e0 WHEN relation_type IN ('supersedes','invalidates') THEN -0.04e0 ELSE 0e0 END END))), 5) AS bonus FROM {ENDS} GROUP BY id")
def n27(spark, d):
    return graph.relation_bonus(fx.relations(spark, d)).select("id", F.round("bonus", 5).alias("bonus"))


@register("a1_counts_by_status", fx.with_("outbox") + "SELECT generation_id, status, operation, count(*) AS n FROM outbox GROUP BY 1, 2, 3")
def a1(spark, d):
    return fx.outbox(spark, d).groupBy("generation_id", "status", "operation").agg(F.count(F.lit(1)).alias("n"))


@register("a2_distinct_counts", fx.with_("claims") + "SELECT scope_id, count(DISTINCT subject_key) AS subjects, count(DISTINCT memory_id) AS memories FROM claims GROUP BY scope_id")
def a2(spark, d):
    return fx.claims(spark, d).groupBy("scope_id").agg(F.countDistinct("subject_key").alias("subjects"), F.countDistinct("memory_id").alias("memories"))


@register("a3_conditional_sums", "SELECT l_returnflag, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS discounted, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 2) AS open_quantity FROM lineitem GROUP BY 1")
def a3(spark, d):
    return fx.read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.round(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0)), 2).alias("open_quantity"))


@register("a4_queue_report", fx.with_("outbox") + "SELECT count(*) AS rows, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'claimed' THEN 1 END) AS claimed, count(CASE WHEN status = 'dead' THEN 1 END) AS dead, max(attempts) AS most_attempts, CAST(floor(epoch(TIMESTAMP '2024-02-15 00:00:00')) - floor(epoch(min(CASE WHEN status IN ('pending', 'claimed') THEN available_at END))) AS BIGINT) AS oldest_s FROM outbox")
def a4(spark, d):
    return reports.queue(fx.outbox(spark, d), fx.AS_OF)


@register("a5_duplicate_groups", fx.with_("memories") + ", g AS (SELECT *, count(*) OVER (PARTITION BY target, dedup_key) AS n, row_number() OVER (PARTITION BY target, dedup_key ORDER BY updated_at DESC, created_at DESC, id DESC) AS place FROM memories) SELECT id, target, place FROM g WHERE n > 1")
def a5(spark, d):
    return reports.duplicates(fx.memories(spark, d), ["target", "dedup_key"]).select("id", "target", "place")


@register("a6_duplicate_extra_rows", fx.with_("memories") + "SELECT target, CAST(sum(n - 1) AS BIGINT) AS extra FROM (SELECT target, dedup_key, count(*) AS n FROM memories GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY target")
def a6(spark, d):
    g = fx.memories(spark, d).groupBy("target", "dedup_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.groupBy("target").agg(F.sum(F.col("n") - 1).alias("extra"))


@register("a12_top_entities", fx.with_("memories", "entities") + "SELECT scope_id, entity, n FROM (SELECT scope_id, entity, count(*) AS n, row_number() OVER (PARTITION BY scope_id ORDER BY count(*) DESC, entity) AS r FROM entities GROUP BY 1, 2) WHERE r <= 10")
def a12(spark, d):
    from ..operators.recall import top

    n = fx.entities(spark, d).groupBy("scope_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    return top(n, "scope_id", 10, F.desc("n"), F.col("entity")).select("scope_id", "entity", "n")


_NOISE = "(?i)^\\[Recent Telegram chat history|^\\[CONTEXT COMPACTION|^\\[System note:|^## Active Task|^## Remaining Work|reply with ok and nothing else|^\\s*you are an ai assistant"
_SECRET = "(?i)(api[_-]?key|token|secret|password|passwd|private[_-]?key)\\s*[:=]\\s*[^\\s]+"


@register("a13_hygiene", fx.with_("memories") + f"SELECT target, count(*) AS rows, count(CASE WHEN regexp_matches(content, '{_NOISE}') THEN 1 END) AS noise, count(CASE WHEN target = 'general' AND source = 'turn-assistant' THEN 1 END) AS assistant, count(CASE WHEN length(trim(content)) <= 24 THEN 1 END) AS very_short, count(CASE WHEN length(content) >= 2400 THEN 1 END) AS very_long FROM memories GROUP BY target")
def a13(spark, d):
    return reports.hygiene(fx.memories(spark, d))


@register(
    "a14_forgetting",
    fx.with_("memories") + f", r AS (SELECT *, row_number() OVER (PARTITION BY scope_id, target, dedup_key ORDER BY created_at, id) AS place FROM memories WHERE {LIFE} <> 'archived'), x AS (SELECT id, CASE WHEN regexp_matches(content, '{_SECRET}') THEN 'secret-like-content' WHEN regexp_matches(content, '{_NOISE}') THEN 'runtime-wrapper-noise' WHEN target = 'general' AND source = 'turn-assistant' THEN 'assistant-prose-scratch' WHEN length(trim(content)) <= 24 THEN 'very-short-low-value' WHEN place > 1 AND dedup_key <> '' THEN 'duplicate-memory' WHEN {LIFE} = 'candidate' THEN 'candidate-review-debt' END AS reason FROM r) SELECT id, reason, CASE WHEN reason IN ('secret-like-content', 'runtime-wrapper-noise') THEN 'hard' WHEN reason = 'candidate-review-debt' THEN 'review' ELSE 'soft' END AS action FROM x WHERE reason IS NOT NULL",
)
def a14(spark, d):
    return reports.forgetting(fx.memories(spark, d))


@register("a18_governance_tiers", fx.with_("memories") + "SELECT CASE WHEN importance >= 0.6 THEN 'core' WHEN importance >= 0.3 THEN 'working' ELSE 'peripheral' END AS tier, count(*) AS n FROM (SELECT coalesce(CASE WHEN json_valid(metadata) THEN CAST(json_extract_string(metadata, '$.importance') AS DOUBLE) END, 0.5e0) AS importance FROM memories) GROUP BY 1")
def a18(spark, d):
    i = F.coalesce(policy.json_text("metadata", "$.importance").cast("double"), F.lit(0.5))
    tier = F.when(i >= 0.6, "core").when(i >= 0.3, "working").otherwise("peripheral")
    return fx.memories(spark, d).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@register("a25_journal_health", fx.with_("journal") + "SELECT scope_id, count(*) AS rows, count(CASE WHEN processed_run_id IS NULL THEN 1 END) AS backlog, count(CASE WHEN role = 'system' THEN 1 END) AS contaminated, count(DISTINCT processed_run_id) AS runs FROM journal GROUP BY scope_id")
def a25(spark, d):
    return fx.journal(spark, d).groupBy("scope_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("processed_run_id").isNull()).alias("backlog"), F.count_if(F.col("role") == "system").alias("contaminated"), F.countDistinct("processed_run_id").alias("runs"))


@register("a26_vector_audit", "SELECT count(*) AS physical, count(DISTINCT vec_id % 400) AS distinct_ids, count(*) - count(DISTINCT vec_id % 400) AS duplicates FROM embeddings")
def a26(spark, d):
    distinct = F.countDistinct(F.col("n") % 400)
    return fx.vectors(spark, d).agg(F.count(F.lit(1)).alias("physical"), distinct.alias("distinct_ids"), (F.count(F.lit(1)) - distinct).alias("duplicates"))


@register("a27_cleanup_reasons", "WITH t AS (SELECT conv_id, lower(role || ': ' || text) AS x FROM conversations) SELECT CASE WHEN x LIKE 'user:%' THEN 'transcript.role-prefix-user' WHEN regexp_matches(x, '(?:^|[\\s。；;])user:\\s*') THEN 'transcript.role-prefix-user' WHEN regexp_matches(x, '(?:^|[\\s。；;])assistant:\\s*') THEN 'transcript.role-prefix-assistant' END AS reason, count(*) AS n FROM t GROUP BY 1")
def a27(spark, d):
    t = fx.journal(spark, d).select(F.concat_ws(": ", "role", "content").alias("content"))
    return t.groupBy(reports.noise_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("a29_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.95), 5) AS p95 FROM events GROUP BY event_type")
def a29(spark, d):
    return fx.read(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 5).alias("p50"), F.round(F.percentile("value", 0.95), 5).alias("p95"))


@register("a35_digest_receipts", fx.with_("journal") + "SELECT processed_run_id AS run, count(*) AS entries, count(DISTINCT session_id) AS sessions, CAST(sum(length(content)) AS BIGINT) AS characters FROM journal WHERE processed_run_id IS NOT NULL GROUP BY 1")
def a35(spark, d):
    return fx.journal(spark, d).where("processed_run_id IS NOT NULL").groupBy(F.col("processed_run_id").alias("run")).agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("session_id").alias("sessions"), F.sum(F.char_length("content").cast("long")).alias("characters"))


@register("n33_transcript_copies", "WITH c AS (SELECT doc_id AS id, source AS grp, length(text) AS raw, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents WHERE doc_id % 2 = 1), s AS (SELECT DISTINCT source AS grp, substr(t, i, 8) AS g FROM (SELECT source, t, unnest(generate_series(1, greatest(length(t) - 7, 1))) AS i FROM (SELECT source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents WHERE doc_id % 2 = 0))), o AS (SELECT id, grp, substr(t, i, 8) AS g FROM (SELECT id, grp, t, unnest(CASE WHEN (length(t) - 8) % 8 <> 0 THEN list_append(generate_series(1, length(t) - 7, 8), length(t) - 7) ELSE generate_series(1, length(t) - 7, 8) END) AS i FROM c WHERE length(t) >= 600)), h AS (SELECT id, count(s.g) / CAST(count(*) AS DOUBLE) AS overlap FROM o LEFT JOIN s ON s.grp = o.grp AND s.g = o.g GROUP BY id) SELECT c.id, round(coalesce(overlap, 0), 6) AS overlap, raw > 16000 OR coalesce(overlap >= 0.75, false) AS copied FROM c LEFT JOIN h ON h.id = c.id")
def n33(spark, d):
    docs = fx.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group"), F.col("text").alias("content"))
    found = reports.transcript_copies(docs.where("id % 2 = 1"), docs.where("id % 2 = 0"))
    return found.select("id", F.round("overlap", 6).alias("overlap"), "copied")


@register("m1_lifecycle_transition", fx.with_("memories") + f"SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 <> 0 THEN 'kept' WHEN {LIFE} = 'archived' THEN 'noop' WHEN {LIFE} = 'promoted' THEN 'applied' ELSE 'conflict' END AS outcome FROM memories")
def m1(spark, d):
    plan = fx.memories(spark, d).where("CAST(id AS BIGINT) % 4 = 0").select("id", F.lit("promoted").alias("expected"), F.lit("archived").alias("next"))
    m = fx.memories(spark, d).join(plan, "id", "left")
    state = policy.lifecycle()
    return m.select("id", F.when(F.col("next").isNull(), "kept").when(state == F.col("next"), "noop").when(state == F.col("expected"), "applied").otherwise("conflict").alias("outcome"))


@register("m11_conflict_metadata", fx.with_("relations") + f"SELECT id, count(DISTINCT peer) AS n, string_agg(DISTINCT peer, ',' ORDER BY peer) AS peers FROM {ENDS} WHERE relation_type = 'contradicts' GROUP BY id")
def m11(spark, d):
    e = graph.both_ends(fx.relations(spark, d)).where("relation_type = 'contradicts'")
    return e.groupBy("id").agg(F.countDistinct("peer").alias("n"), F.array_join(F.sort_array(F.collect_set("peer")), ",").alias("peers"))


@register("m17_recovery_report", fx.with_("journal") + "SELECT scope_id, role, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY session_id, role ORDER BY turn_number DESC) AS r FROM journal) WHERE r = 1 AND processed_run_id IS NULL GROUP BY 1, 2")
def m17(spark, d):
    last = scan.latest_by(fx.journal(spark, d), ["session_id", "role"], F.desc("turn_number")).where("processed_run_id IS NULL")
    return last.groupBy("scope_id", "role").agg(F.count(F.lit(1)).alias("n"))


@register("m22_vector_consistency", fx.with_("memories", "vectors") + f"SELECT category, count(*) AS n FROM (SELECT CASE WHEN m.id IS NULL THEN 'orphan' WHEN v.id IS NULL AND {LIFE} NOT IN {HIDDEN} THEN 'missing' WHEN v.id IS NOT NULL AND {LIFE} IN {HIDDEN} THEN 'stale' WHEN v.id IS NULL THEN 'hidden' ELSE 'ok' END AS category FROM (SELECT DISTINCT CAST(n * 3 AS VARCHAR) AS id FROM vectors) v FULL JOIN memories m ON m.id = v.id) GROUP BY category")
def m22(spark, d):
    v = fx.vectors(spark, d).select((F.col("n") * 3).cast("string").alias("vid")).distinct()
    m = fx.memories(spark, d)
    hidden = policy.lifecycle().isin(*policy.ORDINARY_HIDDEN)
    kind = F.when(F.col("id").isNull(), "orphan").when(F.col("vid").isNull() & ~hidden, "missing").when(F.col("vid").isNotNull() & hidden, "stale").when(F.col("vid").isNull(), "hidden").otherwise("ok")
    return m.join(v, m.id == v.vid, "full").groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@register("m29_dashboard_trend", "WITH a AS (SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1), b AS (SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1) SELECT event_type AS metric, a.n AS now, a.n - b.n AS delta FROM a JOIN b USING (event_type)")
def m29(spark, d):
    e = fx.read(spark, d, "events")
    split = F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return e.groupBy(F.col("event_type").alias("metric")).agg(F.count_if(split).alias("now"), (F.count_if(split) - F.count_if(~split)).alias("delta"))


@register("q26_hidden_vectors", fx.with_("memories", "vectors") + f"SELECT v.id FROM vectors v JOIN memories m ON m.id = v.id WHERE {LIFE} IN {HIDDEN}")
def q26(spark, d):
    m = fx.memories(spark, d).where(policy.lifecycle().isin(*policy.ORDINARY_HIDDEN))
    return fx.vectors(spark, d).join(m.select("id"), "id", "left_semi").select("id")


@register("n20_quality_weight", fx.with_("memories") + "SELECT id, round(0.6e0 + (mean - 0.5e0) * 0.08e0, 6) AS score FROM (SELECT id, CASE WHEN json_valid(metadata) THEN (CAST(json_extract_string(metadata, '$.confidence') AS DOUBLE) + CAST(json_extract_string(metadata, '$.importance') AS DOUBLE)) / 2 ELSE 0.5e0 END AS mean FROM memories)")
def n20(spark, d):
    c, i = (policy.json_text("metadata", f"$.{k}").cast("double") for k in ("confidence", "importance"))
    return fx.memories(spark, d).select("id", F.round(0.6 + (F.coalesce((c + i) / 2, F.lit(0.5)) - 0.5) * 0.08, 6).alias("score"))


@register("n15_similar_summary_text", "SELECT conv_id, turn, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(left(t, 59)) || '…' END AS short FROM (SELECT conv_id, turn, regexp_replace(trim(text), '\\s+', ' ', 'g') AS t FROM conversations)")
def n15(spark, d):
    return fx.read(spark, d, "conversations").select("conv_id", "turn", text.compact("text", 60).alias("short"))
