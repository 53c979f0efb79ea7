"""Queries of governance, playbooks, freshness, queues, lineage and index integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy, text
from ..operators import govern, scan
from . import fixtures as fx
from .recalling import tok
from .registry import register
from .scans import HIDDEN, LIFE, VISIBLE, stamp


def any_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_CLASS = f"CASE WHEN target = 'general' THEN 'episodic' WHEN target = 'user' OR {any_sql('lower(content)', govern.PREFERENCE_WORDS)} THEN 'preference' WHEN target = 'ops' OR {any_sql('lower(content)', govern.OPS_WORDS)} THEN 'procedure' WHEN target = 'project' THEN 'project' ELSE 'factual' END"


@register("n35_classification", fx.with_("memories") + f", c AS (SELECT id, {_CLASS} AS memory_type, CASE WHEN {any_sql('lower(content)', govern.SENSITIVE_WORDS)} THEN 'sensitive' ELSE 'normal' END AS sensitivity FROM memories) SELECT *, CASE memory_type WHEN 'episodic' THEN 0.5e0 WHEN 'preference' THEN 0.86e0 WHEN 'procedure' THEN 0.8e0 WHEN 'project' THEN 0.78e0 ELSE 0.72e0 END AS confidence, CASE memory_type WHEN 'episodic' THEN 0.35e0 WHEN 'preference' THEN 0.86e0 WHEN 'procedure' THEN 0.82e0 WHEN 'project' THEN 0.78e0 ELSE 0.68e0 END AS importance FROM c")
def n35(spark, d):
    return govern.classify(fx.memories(spark, d))


@register("n34_safe_merges", fx.with_("memories") + "SELECT a.id AS a, b.id AS b FROM memories a JOIN memories b ON a.scope_id = b.scope_id AND a.target = b.target AND a.id < b.id WHERE a.dedup_key <> '' AND b.dedup_key <> '' AND (a.dedup_key = b.dedup_key OR least(length(a.dedup_key), length(b.dedup_key)) >= 12 AND (contains(a.dedup_key, b.dedup_key) OR contains(b.dedup_key, a.dedup_key)))")
def n34(spark, d):
    return govern.safe_merges(fx.memories(spark, d))


@register("a8_frequency_prefilter", fx.with_("memories") + f", t AS (SELECT DISTINCT id, unnest({tok('content')}) AS term FROM memories), n AS (SELECT count(*) AS n FROM memories) SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) <= greatest(50, 0.05e0 * (SELECT n FROM n)) AND count(*) > 5")
def a8(spark, d):
    m = fx.memories(spark, d)
    n = m.count()
    df = m.select("id", F.explode(text.query_tokens("content")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.where((F.col("df") <= max(50, 0.05 * n)) & (F.col("df") > 5))


@register("m10_freshness_policy", fx.with_("memories") + ", f AS (SELECT id, coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.memory_type') END, '') AS k FROM memories), g AS (SELECT id, k, CASE k WHEN 'preference' THEN 365 WHEN 'decision' THEN 0 WHEN 'episodic' THEN 0 WHEN 'resource' THEN 365 ELSE 30 END AS ttl_days FROM f) SELECT id, ttl_days, CASE WHEN k IN ('preference', 'resource') THEN strftime(TIMESTAMP '2024-02-01 00:00:00' + INTERVAL '1' DAY * ttl_days, '%Y-%m-%d %H:%M:%S') END AS until FROM g")
def m10(spark, d):
    return govern.freshness_plan(fx.memories(spark, d), "2024-02-01 00:00:00").select("id", "ttl_days", stamp("valid_until").alias("until"))


@register("a21_shadow_index_integrity", fx.with_("memories") + f", idx AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN 'drift' ELSE sha256(content) END AS h FROM memories WHERE CAST(id AS BIGINT) % 20 <> 0) SELECT problem, count(*) AS n FROM (SELECT CASE WHEN i.id IS NULL AND {VISIBLE} THEN 'missing' WHEN i.id IS NOT NULL AND NOT {VISIBLE} THEN 'hidden' WHEN i.h <> sha256(m.content) THEN 'drift' ELSE 'ok' END AS problem FROM memories m LEFT JOIN idx i ON i.id = m.id) GROUP BY problem")
def a21(spark, d):
    m = fx.memories(spark, d)
    n = F.col("id").cast("long")
    idx = m.where(n % 20 != 0).select(F.col("id").alias("i"), F.when(n % 13 == 0, "drift").otherwise(F.sha2("content", 256)).alias("h"))
    seen = policy.ordinary_visible()
    problem = F.when(F.col("i").isNull() & seen, "missing").when(F.col("i").isNotNull() & ~seen, "hidden").when(F.col("h") != F.sha2("content", 256), "drift").otherwise("ok")
    return m.join(idx, m.id == F.col("i"), "left").groupBy(problem.alias("problem")).agg(F.count(F.lit(1)).alias("n"))


BOOKS = "SELECT p_partkey AS playbook, p_name AS title, p_type AS goal, p_brand AS task_class, p_size % 5 AS success_count, p_size % 3 AS failure_count, p_size % 4 AS stale_count, (p_partkey % 10) / 10e0 AS confidence, p_partkey % 2 = 0 AS promoted FROM part"


def books(spark, d):
    return fx.read(spark, d, "part").selectExpr("p_partkey AS playbook", "p_name AS title", "p_type AS goal", "p_brand AS task_class", "p_size % 5 AS success_count", "p_size % 3 AS failure_count", "p_size % 4 AS stale_count", "(p_partkey % 10) / 10E0 AS confidence", "p_partkey % 2 = 0 AS promoted")


@register("n43_playbook_confidence", f"SELECT playbook, round(greatest(0e0, least(0.95e0, 0.65e0 * confidence + 0.30e0 * (success_count + 1) / (success_count + failure_count + 2) + CASE WHEN promoted THEN 0.05e0 ELSE 0e0 END - least(0.2e0, 0.05e0 * stale_count) - CASE WHEN failure_count > 0 AND failure_count >= success_count THEN 0.15e0 ELSE 0e0 END)), 6) AS confidence FROM ({BOOKS})")
def n43(spark, d):
    return books(spark, d).select("playbook", F.round(govern.playbook_confidence(*map(F.col, ("confidence", "success_count", "failure_count", "stale_count", "promoted"))), 6).alias("confidence"))


@register("q20_playbook_search", f"SELECT playbook, score FROM (SELECT playbook, 2.5e0 * (CAST(contains(lower(title), 'small') AS INT) + CAST(contains(lower(title), '12') AS INT)) + 2.5e0 * (CAST(contains(lower(goal), 'small') AS INT) + CAST(contains(lower(goal), '12') AS INT)) + CAST(contains(lower(task_class), 'small') AS INT) + CAST(contains(lower(task_class), '12') AS INT) AS score FROM ({BOOKS})) WHERE score > 0 ORDER BY score DESC, playbook LIMIT 20")
def q20(spark, d):
    b = books(spark, d)
    score = govern.playbook_score(b, "Small-12", {"title": 2.5, "goal": 2.5, "task_class": 1.0})
    return b.select("playbook", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "playbook").limit(20)


@register("m23_playbook_feedback", "SELECT user_id AS playbook, count(CASE WHEN o = 0 THEN 1 END) AS success, count(CASE WHEN o IN (1, 2) THEN 1 END) AS failure, count(CASE WHEN o = 3 THEN 1 END) AS stale FROM (SELECT user_id, event_id % 6 AS o FROM events) GROUP BY 1")
def m23(spark, d):
    outcome = F.element_at(F.array(*map(F.lit, ["success", "failed", "misleading", "stale", "partial", "unknown"])), (F.col("event_id") % 6 + 1).cast("int"))
    return govern.feedback_counts(fx.read(spark, d, "events").select(F.col("user_id").alias("playbook"), outcome.alias("outcome")))


@register("m26_skill_candidates", f"SELECT playbook FROM (SELECT * FROM ({BOOKS}) ORDER BY confidence DESC, success_count DESC, playbook DESC LIMIT 100) WHERE success_count >= 2 AND confidence >= 0.75")
def m26(spark, d):
    best = books(spark, d).orderBy(F.desc("confidence"), F.desc("success_count"), F.desc("playbook")).limit(100)
    return best.where("success_count >= 2 AND confidence >= 0.75").select("playbook")


@register("st2_claimable_events", fx.with_("outbox") + "SELECT id FROM outbox WHERE (status = 'pending' OR status = 'claimed' AND updated_at + INTERVAL '300' SECOND <= TIMESTAMP '2024-01-10 00:00:00') AND available_at <= TIMESTAMP '2024-01-10 00:00:00' ORDER BY available_at, id LIMIT 200")
def st2(spark, d):
    return govern.claimable(fx.outbox(spark, d), "2024-01-10 00:00:00", 300, 200).select("id")


@register("st4_dead_letters", fx.with_("outbox") + "SELECT id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 5 THEN 'dead' ELSE 'pending' END AS status FROM outbox WHERE status = 'claimed'")
def st4(spark, d):
    o = fx.outbox(spark, d)
    failed = o.where("status = 'claimed'").select("id")
    return govern.after_failure(o, failed, 5).join(failed, "id", "left_semi").select("id", "attempts", "status")


@register("st7_scope_revision", fx.with_("memories") + "SELECT scope_id, CAST(max(CAST(id AS BIGINT)) AS BIGINT) AS revision, count(*) AS changes FROM memories GROUP BY scope_id")
def st7(spark, d):
    return fx.memories(spark, d).groupBy("scope_id").agg(F.max(F.col("id").cast("long")).alias("revision"), F.count(F.lit(1)).alias("changes"))


@register("m2_archive", fx.with_("memories") + f"SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 AND {LIFE} = 'promoted' THEN 'archived' ELSE {LIFE} END AS lifecycle FROM memories")
def m2(spark, d):
    m = fx.memories(spark, d)
    plan = m.where("CAST(id AS BIGINT) % 3 = 0").select("id", F.lit("archived").alias("next"), F.lit("promoted").alias("expected"))
    return govern.transition(m, plan).select("id", "lifecycle")


@register("m3_hard_delete", fx.with_("memories") + f"SELECT id FROM memories WHERE {LIFE} NOT IN ('rejected', 'obsolete')")
def m3(spark, d):
    m = fx.memories(spark, d)
    return scan.delete(m, m.where(policy.lifecycle().isin("rejected", "obsolete")), "id").select("id")


@register("m4_rollback_batch", fx.with_("memories") + f"SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'promoted' ELSE 'candidate' END AS restored FROM memories WHERE {LIFE} = 'archived' AND CAST(id AS BIGINT) % 3 = 1")
def m4(spark, d):
    m = fx.memories(spark, d).withColumn("lifecycle", policy.lifecycle())
    n = F.col("id").cast("long")
    audit = m.select("id", F.concat(F.lit("b"), (n % 3).cast("string")).alias("batch_id"), F.when(n % 2 == 0, "promoted").otherwise("candidate").alias("before"))
    return govern.rollback(m, audit, "b1")


@register("m6_secret_index", "SELECT doc_id, sha256(regexp_extract(text, 'token\\s*=\\s*\"([^\"]+)\"', 1)) AS fingerprint FROM documents WHERE regexp_matches(text, 'token\\s*=\\s*\"[^\"]+\"')")
def m6(spark, d):
    found = fx.read(spark, d, "documents").where(F.col("text").rlike(r'token\s*=\s*"[^"]+"'))
    return found.select("doc_id", F.sha2(F.regexp_extract("text", r'token\s*=\s*"([^"]+)"', 1), 256).alias("fingerprint"))


@register("m16_backlog_limit", fx.with_("journal") + "SELECT count(*) AS backlog, least(500, greatest(50, count(*) // 2)) AS next_limit FROM journal WHERE processed_run_id IS NULL")
def m16(spark, d):
    n = F.count(F.lit(1))
    return fx.journal(spark, d).where("processed_run_id IS NULL").agg(n.alias("backlog"), F.least(F.lit(500).cast("long"), F.greatest(F.lit(50).cast("long"), F.floor(n / 2))).alias("next_limit"))


@register("m21_dead_letter_report", fx.with_("outbox") + "SELECT generation_id, operation, count(*) AS n, max(attempts) AS attempts FROM outbox WHERE status = 'dead' GROUP BY 1, 2")
def m21(spark, d):
    return fx.outbox(spark, d).where("status = 'dead'").groupBy("generation_id", "operation").agg(F.count(F.lit(1)).alias("n"), F.max("attempts").alias("attempts"))


@register("n40_evolution_policy", "SELECT event_id, CASE WHEN NOT (dr >= 1 OR co >= 2) THEN 'reject' WHEN confidence < CASE WHEN action IN ('add', 'enrich') THEN 0.65 ELSE 0.80 END THEN 'review' WHEN action IN ('supersede', 'retract') AND dr < 1 THEN 'review' ELSE 'allow' END AS decision FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'enrich' WHEN 2 THEN 'supersede' ELSE 'retract' END AS action, event_id % 2 AS dr, event_id % 3 AS co, (event_id % 100) / 100e0 AS confidence FROM events)")
def n40(spark, d):
    p = fx.read(spark, d, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'enrich' WHEN 2 THEN 'supersede' ELSE 'retract' END AS action", "event_id % 2 AS direct", "event_id % 3 AS corroborating", "(event_id % 100) / 100E0 AS confidence")
    return govern.evolution_decision(p).select("event_id", "decision")


@register("q16_dedupe_plan", fx.with_("memories") + "SELECT id, keep_id FROM (SELECT id, first_value(id) OVER w AS keep_id, row_number() OVER w AS r FROM memories WINDOW w AS (PARTITION BY scope_id, target, dedup_key ORDER BY updated_at DESC, created_at DESC, id DESC)) WHERE r > 1")
def q16(spark, d):
    from ..operators import reports

    rows = reports.duplicates(fx.memories(spark, d), ["scope_id", "target", "dedup_key"])
    keep = rows.where("place = 1").select("scope_id", "target", "dedup_key", F.col("id").alias("keep_id"))
    return rows.where("place > 1").join(keep, ["scope_id", "target", "dedup_key"]).select("id", "keep_id")


@register("q24_untracked_freshness", fx.with_("memories") + "SELECT id FROM memories WHERE id NOT IN (SELECT CAST(event_id % 900 AS VARCHAR) FROM events) ORDER BY id")
def q24(spark, d):
    tracked = fx.read(spark, d, "events").select((F.col("event_id") % 900).cast("string").alias("id"))
    return scan.missing(fx.memories(spark, d), tracked, "id").select("id")


@register("o8_history_order", fx.with_("claims") + "SELECT claim_id FROM claims WHERE subject_key = 'user:7' ORDER BY valid_from NULLS FIRST, recorded_at, claim_id LIMIT 30")
def o8(spark, d):
    return fx.claims(spark, d).where("subject_key = 'user:7'").orderBy(F.asc_nulls_first("valid_from"), "recorded_at", "claim_id").limit(30).select("claim_id")


@register("o10_scope_budget", fx.with_("claims") + "SELECT claim_id FROM (SELECT claim_id, row_number() OVER (ORDER BY scope_id, valid_from, claim_id) AS r FROM claims WHERE status = 'current') WHERE r <= 120")
def o10(spark, d):
    return fx.claims(spark, d).where("status = 'current'").orderBy("scope_id", "valid_from", "claim_id").limit(120).select("claim_id")


@register("q16_merged_texts")
def q16m(spark, d):
    """What a reviewed merge of each note into the one that holds all it says would read; lines stand as segments."""
    notes = fx.notes(spark, d).withColumn("content", F.regexp_replace("content", "\n", "\n§\n"))
    n = F.col("n")
    pairs = notes.select(F.col("id").alias("a"), (n + n % 25 + 1).cast("string").alias("b"))
    merged = govern.merged_texts(notes, pairs.unionByName(govern.safe_merges(fx.memories(spark, d))).distinct())
    return merged.select("a", "b", F.sha2("content", 256).alias("content_sha256"), "segments", F.size(F.array_distinct(F.flatten("origins"))).alias("sides"))
