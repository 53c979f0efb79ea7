"""Queries of the bitemporal ledger, its evidence and its integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy
from ..operators import scan, temporal
from . import fixtures as fx
from .registry import register
from .scans import LIFE

T = "TIMESTAMP '2024-01-15 12:00:00'"
VALID = f"(valid_from IS NULL OR valid_from <= {T}) AND (valid_to IS NULL OR valid_to > {T})"


@register("q6_facts_current", fx.with_("claims") + f"SELECT subject_key, predicate_key, value, status = 'uncertain' OR assertion_kind = 'inferred' OR confidence < 0.75 AS uncertain FROM claims WHERE status = 'current' AND retired_at IS NULL AND {VALID.replace('2024-01-15', '2024-01-29')}")
def q6(spark, d):
    return temporal.current(fx.claims(spark, d), "2024-01-29 12:00:00").select("subject_key", "predicate_key", "value", policy.uncertain().alias("uncertain"))


@register("q6_facts_as_of", fx.with_("claims") + f"SELECT claim_id, subject_key, predicate_key, value, confidence FROM claims WHERE {VALID}")
def q6a(spark, d):
    return temporal.as_of(fx.claims(spark, d), "2024-01-15 12:00:00").select("claim_id", "subject_key", "predicate_key", "value", "confidence")


@register("q6_facts_as_known", fx.with_("claims") + f", k AS (SELECT * REPLACE (CASE WHEN retired_at > TIMESTAMP '2024-01-16 00:00:00' THEN NULL ELSE valid_to END AS valid_to, CASE WHEN retired_at > TIMESTAMP '2024-01-16 00:00:00' THEN 'current' ELSE status END AS status) FROM claims WHERE recorded_at <= TIMESTAMP '2024-01-16 00:00:00') SELECT claim_id, status, valid_to IS NULL AS open FROM k WHERE {VALID}")
def q6k(spark, d):
    return temporal.as_of(fx.claims(spark, d), "2024-01-15 12:00:00", "2024-01-16 00:00:00").select("claim_id", "status", F.col("valid_to").isNull().alias("open"))


@register("q6_facts_history", fx.with_("claims") + "SELECT claim_id, row_number() OVER w AS place, lag(claim_id) OVER w AS previous FROM claims WINDOW w AS (PARTITION BY scope_id, subject_key, predicate_key ORDER BY valid_from NULLS FIRST, recorded_at, claim_id)")
def q6h(spark, d):
    return temporal.history(fx.claims(spark, d)).select("claim_id", "place", "previous")


_NEXT = "lead(claim_id) OVER (PARTITION BY subject_key, predicate_key ORDER BY valid_from, claim_id)"


@register("j10_predecessors", fx.with_("claims") + f", s AS (SELECT *, CAST(CAST(claim_id AS BIGINT) - CAST(claim_id AS BIGINT) % 3 + 3 AS VARCHAR) AS nxt FROM claims WHERE status = 'superseded'), r AS (SELECT nxt, claim_id, row_number() OVER (PARTITION BY nxt ORDER BY recorded_at, claim_id) AS n FROM s) SELECT nxt AS successor, max(CASE WHEN n = 1 THEN claim_id END) AS predecessor, max(n) >= 2 AS conflict FROM r GROUP BY nxt")
def j10(spark, d):
    n = F.col("claim_id").cast("long")
    c = fx.claims(spark, d).withColumn("superseded_by_claim_id", F.when(F.col("status") == "superseded", (n - n % 3 + 3).cast("string")))
    return temporal.predecessors(c)


@register("j11_overlapping_validity", fx.with_("claims") + ", x AS (SELECT * REPLACE (valid_to + (CAST(claim_id AS BIGINT) % 3) * INTERVAL '2' HOUR AS valid_to) FROM claims) SELECT a.claim_id AS a, b.claim_id AS b FROM x a JOIN x b ON a.scope_id = b.scope_id AND a.subject_key = b.subject_key AND a.predicate_key = b.predicate_key AND (a.valid_from < b.valid_from OR a.valid_from = b.valid_from AND a.claim_id < b.claim_id) AND (a.valid_to IS NULL OR a.valid_to > b.valid_from)")
def j11(spark, d):
    c = fx.claims(spark, d).withColumn("valid_to", F.expr("valid_to + (CAST(claim_id AS BIGINT) % 3) * INTERVAL '2' HOUR"))
    return temporal.overlapping_pairs(c).select("a", "b")


@register("k12_link_evidence", "SELECT DISTINCT l_orderkey, l_returnflag AS source_type, l_partkey AS source_ref, sha256(l_linestatus) AS evidence_hash FROM lineitem")
def k12(spark, d):
    e = fx.read(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("source_type"), F.col("l_partkey").alias("source_ref"), F.sha2("l_linestatus", 256).alias("evidence_hash"))
    return e.dropDuplicates(["l_orderkey", "source_type", "source_ref", "evidence_hash"])


@register("k13_close_interval", fx.with_("claims") + "SELECT claim_id, CASE WHEN CAST(claim_id AS BIGINT) % 4 = 1 AND status = 'current' THEN 'retracted' ELSE status END AS status, CAST(claim_id AS BIGINT) % 4 = 1 AND status = 'current' AS closed FROM claims")
def k13(spark, d):
    c = fx.claims(spark, d)
    plan = c.where(F.col("claim_id").cast("long") % 4 == 1).select("claim_id", F.lit("current").alias("expected_status"), F.lit("retracted").alias("new_status"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("at"))
    return temporal.close(c, plan).select("claim_id", "status", "closed")


@register("w1_top_evidence", "SELECT l_orderkey, l_linenumber, place FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS place FROM lineitem) WHERE place <= 3")
def w1(spark, d):
    return temporal.top_evidence(fx.read(spark, d, "lineitem"), "l_orderkey", 3, F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey")).select("l_orderkey", "l_linenumber", "place")


@register("a9_evidence_counts", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def a9(spark, d):
    n = fx.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = fx.read(spark, d, "orders").select("o_orderkey")
    return o.join(n, o.o_orderkey == n.l_orderkey, "left").select("o_orderkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


_ROUTES = "SELECT user_id AS query_id, event_type AS route, event_id % 60 AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank FROM events"


@register("w5_round_robin", f"WITH r AS ({_ROUTES}), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY rank, route) AS turn FROM r WHERE rank <= 5) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, route, id) AS place FROM f WHERE turn = 1")
def w5(spark, d):
    routes = fx.read(spark, d, "events").selectExpr("user_id AS query_id", "event_type AS route", "event_id % 60 AS id", "row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank").where("rank <= 5")
    return temporal.interleaved(routes).select("query_id", "id", "place")


@register("w4_later_current", fx.with_("memories") + f"SELECT id, coalesce(max(CASE WHEN {LIFE} = 'promoted' THEN 1 ELSE 0 END) OVER (PARTITION BY scope_id ORDER BY CAST(id AS BIGINT) ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM memories")
def w4(spark, d):
    from pyspark.sql import Window as W

    after = W.partitionBy("scope_id").orderBy(F.col("id").cast("long").desc()).rowsBetween(W.unboundedPreceding, -1)
    return fx.memories(spark, d).select("id", F.coalesce(F.max((policy.lifecycle() == "promoted").cast("int")).over(after), F.lit(0)).alias("later"))


@register("w6_keep_newest_of_generation", fx.with_("outbox") + "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY generation_id ORDER BY updated_at DESC, id DESC) AS n FROM outbox WHERE status = 'completed') WHERE n > 100 AND updated_at < TIMESTAMP '2024-01-20 00:00:00'")
def w6(spark, d):
    done = fx.outbox(spark, d).where("status = 'completed'").selectExpr("*", "row_number() OVER (PARTITION BY generation_id ORDER BY updated_at DESC, id DESC) AS n")
    return done.where("n > 100 AND updated_at < TIMESTAMP '2024-01-20 00:00:00'").select("id")


@register("a23_index_identity", fx.with_("claims") + "SELECT 'missing' AS side, count(*) AS n FROM (SELECT claim_id FROM claims EXCEPT SELECT claim_id FROM claims WHERE CAST(claim_id AS BIGINT) % 100 <> 7) UNION ALL SELECT 'stale', count(*) FROM (SELECT claim_id FROM claims WHERE CAST(claim_id AS BIGINT) % 100 <> 7 EXCEPT SELECT claim_id FROM claims)")
def a23(spark, d):
    truth = fx.claims(spark, d).select("claim_id")
    index = truth.where("CAST(claim_id AS BIGINT) % 100 <> 7")
    side = lambda name, rows: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return side("missing", truth.subtract(index)).unionByName(side("stale", index.subtract(truth)))


@register("a24_claim_coverage", fx.with_("memories", "claims") + "SELECT count(*) AS memories, count(c.memory_id) AS covered, round(count(c.memory_id) / CAST(count(*) AS DOUBLE), 6) AS rate FROM memories m LEFT JOIN (SELECT DISTINCT memory_id FROM claims WHERE status = 'current') c ON c.memory_id = m.id")
def a24(spark, d):
    c = fx.claims(spark, d).where("status = 'current'").select("memory_id").distinct()
    m = fx.memories(spark, d).select("id")
    return m.join(c, m.id == c.memory_id, "left").agg(F.count(F.lit(1)).alias("memories"), F.count("memory_id").alias("covered"), F.round(F.count("memory_id") / F.count(F.lit(1)), 6).alias("rate"))


@register("j3_claims_of_memories", fx.with_("memories", "claims") + "SELECT claim_id, target FROM claims c JOIN memories m ON c.memory_id = m.id AND CAST(m.id AS BIGINT) % 7 = CAST(substr(c.scope_id, 7) AS BIGINT)")
def j3(spark, d):
    m = fx.memories(spark, d).select("id", "target", F.concat(F.lit("scope-"), (F.col("id").cast("long") % 7).cast("string")).alias("s"))
    c = fx.claims(spark, d)
    return c.join(m, (c.memory_id == m.id) & (c.scope_id == m.s)).select("claim_id", "target")


@register("j16_worst_freshness", fx.with_("memories") + "SELECT m.id, coalesce(f.severity, 0) AS severity FROM memories m LEFT JOIN (SELECT CAST(event_id % 700 AS VARCHAR) AS id, max(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 3 ELSE 2 END) AS severity FROM events GROUP BY 1) f ON f.id = m.id")
def j16(spark, d):
    e = fx.read(spark, d, "events").select((F.col("event_id") % 700).cast("string").alias("id"), policy.mapped(F.col("event_type"), {"click": 0, "view": 1, "purchase": 3}, 2).alias("severity"))
    worst = e.groupBy("id").agg(F.max("severity").alias("severity"))
    return fx.memories(spark, d).select("id").join(worst, "id", "left").select("id", F.coalesce("severity", F.lit(0)).alias("severity"))


@register("q25_supersede_plan", fx.with_("claims") + ", p AS (SELECT max(CAST(claim_id AS BIGINT)) AS new_id, scope_id, subject_key, predicate_key FROM claims GROUP BY 2, 3, 4) SELECT c.claim_id, 'superseded' AS new_status, CAST(p.new_id AS VARCHAR) AS superseded_by FROM claims c JOIN p USING (scope_id, subject_key, predicate_key) WHERE c.retired_at IS NULL AND CAST(c.claim_id AS BIGINT) <> p.new_id")
def q25(spark, d):
    c = fx.claims(spark, d)
    newest = c.groupBy(*temporal.SLOT).agg(F.max(F.col("claim_id").cast("long")).alias("new_id"))
    rows = c.where("retired_at IS NULL").join(newest, temporal.SLOT).where(F.col("claim_id").cast("long") != F.col("new_id"))
    return rows.select("claim_id", F.lit("superseded").alias("new_status"), F.col("new_id").cast("string").alias("superseded_by"))


@register("m31_replay_check", fx.with_("outbox") + "SELECT event_key, count(*) AS n, count(DISTINCT operation) > 1 AS conflict FROM outbox GROUP BY event_key")
def m31(spark, d):
    return fx.outbox(spark, d).groupBy("event_key").agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("operation") > 1).alias("conflict"))


@register("st3_newest_event_wins", fx.with_("outbox") + "SELECT event_key, id, operation FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY updated_at DESC, id DESC) AS n FROM outbox) WHERE n = 1")
def st3(spark, d):
    return scan.latest_by(fx.outbox(spark, d), "event_key", F.desc("updated_at"), F.desc("id")).select("event_key", "id", "operation")
