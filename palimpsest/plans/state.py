"""Queries of states and transitions over whole tables: peers, syncs, audits, reviews, versions, events, recovery, grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence, policy, relations, text
from ..operators import digest, govern, graph, recall, relate, reports, scan, temporal
from ..sources import files, stores
from ..sources.scratch import folder, written
from . import fixtures as fx
from .hybrid import BASE, BM25, entity_cte, in_order, raw_entities
from .hybrid import stores as stores_of
from .noted import _DISTINCTIVE, q
from .recalling import STEM, listed, tok
from .registry import register
from .scans import LIFE, TS, VISIBLE, stamp

POSTED = entity_cte("en", "id, scope_id", raw_entities("content"), "notes") + f", po AS (SELECT id, scope_id, e FROM (SELECT id, scope_id, unnest(es) AS e FROM en) WHERE {_DISTINCTIVE})"


@register("j13_entity_peers", fx.with_("notes") + POSTED + ", sz AS (SELECT scope_id, count(DISTINCT id) AS n FROM po GROUP BY 1), bl AS (SELECT scope_id, e FROM po JOIN sz USING (scope_id) GROUP BY scope_id, e, n HAVING n >= 20 AND count(DISTINCT id) >= greatest(12, ceil(0.03e0 * n))), "
    "ok AS (SELECT * FROM po WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.scope_id = po.scope_id AND bl.e = po.e)), sh AS (SELECT id, greatest(2, least(6, 5 // count(*) + 2)) AS each FROM ok GROUP BY 1), pr AS (SELECT a.id, a.e, b.id AS peer, row_number() OVER (PARTITION BY a.id, a.e ORDER BY b.id) AS k FROM ok a JOIN ok b ON a.scope_id = b.scope_id AND a.e = b.e AND a.id <> b.id), "
    "f AS (SELECT id, peer, min(e) AS e FROM pr JOIN sh USING (id) WHERE k <= each GROUP BY 1, 2), f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY e, peer) AS place FROM f) WHERE place <= 5), "
    "nw AS (SELECT id, scope_id, row_number() OVER (PARTITION BY scope_id ORDER BY updated_at DESC, id DESC) AS age FROM notes), fl AS (SELECT a.id, b.id AS peer, b.age FROM notes a JOIN nw b ON a.scope_id = b.scope_id AND a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM f2 WHERE f2.id = a.id AND f2.peer = b.id)), "
    "al AS (SELECT id, peer, 0 AS late, place FROM f2 UNION ALL SELECT id, peer, 1, age FROM fl) SELECT id AS memory_id, peer, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY late, place, peer) AS n FROM al) WHERE n <= 5")
def j13(spark, d):
    n = fx.notes(spark, d)
    posted = written(relate.postings(n))  # texts are read once
    blocked = graph.entity_frequency(posted).where("blocked").select("scope_id", "entity")
    return graph.peers(posted.join(blocked, ["scope_id", "entity"], "left_anti"), n.select("scope_id", "id", "updated_at"), 5)


#: An index of entities as it was when every ninth note still read otherwise.
_WAS = "CASE WHEN n % 9 = 2 THEN concat('svc-old depends on ', left(content, 30)) ELSE content END"
_INDEX = POSTED + f", was AS (SELECT id, scope_id, {_WAS} AS content FROM notes)" + entity_cte("eo", "id, scope_id", raw_entities("content"), "was") + f", old AS (SELECT id, scope_id, e FROM (SELECT id, scope_id, unnest(es) AS e FROM eo) WHERE {_DISTINCTIVE})"


@register("m9_entity_sync", fx.with_("notes") + _INDEX + " SELECT id AS memory_id, e AS entity, 'add' AS action FROM (SELECT id, e FROM po EXCEPT SELECT id, e FROM old) UNION ALL SELECT id, e, 'remove' FROM (SELECT id, e FROM old EXCEPT SELECT id, e FROM po)")
def m9(spark, d):
    n = fx.notes(spark, d)
    was = n.withColumn("content", F.expr(_WAS))
    return graph.entity_sync(relate.postings(was), relate.postings(n))


@register("m13_frequency_drift", fx.with_("notes") + _INDEX + ", a AS (SELECT scope_id, e, count(*) AS k FROM old GROUP BY 1, 2), b AS (SELECT scope_id, e, count(*) AS n FROM po GROUP BY 1, 2) SELECT scope_id, e AS entity, coalesce(k, 0) AS kept, coalesce(n, 0) AS now FROM a FULL JOIN b USING (scope_id, e) WHERE coalesce(k, 0) <> coalesce(n, 0)")
def m13(spark, d):
    n = fx.notes(spark, d)
    kept = relate.postings(n.withColumn("content", F.expr(_WAS))).groupBy("scope_id", "entity").agg(F.countDistinct("memory_id").alias("n"))
    return graph.frequency_drift(kept, relate.postings(n))


@register("a20_index_membership", fx.with_("memories", "notes") + f", truth AS (SELECT id FROM memories WHERE {VISIBLE}), idx AS (SELECT DISTINCT id, unnest({tok('content')}) AS t FROM notes WHERE n % 13 <> 4), i AS (SELECT DISTINCT id FROM idx) SELECT (SELECT count(*) FROM truth) AS truth, (SELECT count(*) FROM i) AS indexed, (SELECT count(*) FROM truth WHERE id NOT IN (SELECT id FROM i)) AS missing, (SELECT count(*) FROM i WHERE id NOT IN (SELECT id FROM truth)) AS stale")
def a20(spark, d):
    truth = fx.memories(spark, d).where(policy.ordinary_visible()).select("id")
    index = recall.postings(fx.notes(spark, d).where("n % 13 <> 4")).where("term <> ''")
    i = index.select(F.col("id").alias("i")).distinct()
    j = truth.join(i, truth.id == i.i, "full")
    return j.agg(F.count("id").alias("truth"), F.count("i").alias("indexed"), F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("id").isNull()).alias("stale"))


@register("a19_audit_coverage", fx.with_("memories") + f", h AS (SELECT *, CAST(id AS BIGINT) AS n FROM memories WHERE {LIFE} IN ('archived', 'obsolete', 'rejected', 'superseded')) SELECT target, count(*) AS hidden, count(CASE WHEN n % 3 = 0 THEN 1 END) AS audited, count(CASE WHEN n % 3 <> 0 AND created_at < TIMESTAMP '2023-06-01 00:00:00' THEN 1 END) AS legacy, round(count(CASE WHEN n % 3 = 0 THEN 1 END) / CAST(nullif(count(CASE WHEN NOT (n % 3 <> 0 AND created_at < TIMESTAMP '2023-06-01 00:00:00') THEN 1 END), 0) AS DOUBLE), 6) AS coverage FROM h GROUP BY target")
def a19(spark, d):
    m = fx.memories(spark, d).where(~policy.durable_visible())
    audit = m.where("CAST(id AS BIGINT) % 3 = 0").select(F.col("id").alias("target_id"), F.sha2(F.concat_ws("|", "id", policy.lifecycle()), 256).alias("event_key"))
    rows = m.join(audit.select("target_id").distinct(), m.id == F.col("target_id"), "left")
    legacy = F.col("target_id").isNull() & (F.col("created_at") < F.lit("2023-06-01 00:00:00").cast("timestamp"))
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("hidden"), F.count("target_id").alias("audited"), F.count_if(legacy).alias("legacy"), F.round(F.count("target_id") / F.nullif(F.count_if(~legacy), F.lit(0)), 6).alias("coverage"))


@register("k4_upsert_vectors", "SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 4 = 0 THEN 'moved' ELSE 'label-' || CAST(label AS VARCHAR) END AS scope_id, round(CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END * CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id % 10 <> 7")
def k4(spark, d):
    v = fx.vectors(spark, d)
    store = stores.store(spark, "folder")
    rows = v.select("id", "scope_id", "vector", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"), "n")
    store.upsert(rows.drop("n"))
    changed = rows.where("n % 4 = 0").withColumns({"scope_id": F.lit("moved"), "vector": F.transform(F.col("vector"), lambda x: x.cast("double") * 2)})
    store.upsert(changed.drop("n"))
    store.delete(rows.where("n % 10 = 7").select("id"))
    return store.compact().read().select("id", "scope_id", F.round(F.element_at("vector", 1), 6).alias("first"))


@register("a26_store_audit", "SELECT count(*) + count(CASE WHEN vec_id % 4 = 0 THEN 1 END) AS physical, count(*) AS unique_ids, count(CASE WHEN vec_id % 4 = 0 THEN 1 END) AS duplicates FROM embeddings")
def a26(spark, d):
    v = fx.vectors(spark, d).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    store = stores.store(spark)
    store.upsert(v)
    store.upsert(v.where("n % 4 = 0"))
    return store.audit()


@register("st5_reconciliation_pages", fx.with_("memories") + ", p AS (SELECT id, row_number() OVER (ORDER BY updated_at, id) AS place FROM memories) SELECT (place - 1) // 64 AS page, count(*) AS n, min_by(id, place) AS first_id, max_by(id, place) AS last_id FROM p GROUP BY 1")
def st5(spark, d):
    return scan.pages(fx.memories(spark, d), 64)


_CHANGES = "SELECT CAST(user_id AS {s}) AS playbook, event_id AS change_id, event_type AS change_type FROM events WHERE event_type <> 'purchase'"


@register("k14_playbook_versions", f"WITH v AS (SELECT CAST(user_id AS VARCHAR) AS playbook, count(*) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1), c AS ({_CHANGES.format(s='VARCHAR')}) SELECT playbook, coalesce(last, 0) + row_number() OVER (PARTITION BY playbook ORDER BY change_id) AS version, change_type FROM c LEFT JOIN v USING (playbook)")
def k14(spark, d):
    e = fx.read(spark, d, "events").select(F.col("user_id").cast("string").alias("playbook"), F.col("event_id").alias("change_id"), F.col("event_type").alias("change_type"))
    from pyspark.sql import Window as W

    there = e.where("change_type = 'purchase'").withColumn("version", F.row_number().over(W.partitionBy("playbook").orderBy("change_id")))
    return govern.new_versions(there, e.where("change_type <> 'purchase'"))


_BOOK = "concat('[\"', replace(p_type, ' ', '\",\"'), '\"]')"
_STATE = "CASE p_partkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'review' ELSE 'quarantined' END"


@register("m24_skill_governance", f"WITH b AS (SELECT p_partkey AS playbook, {_STATE} AS status, CAST({_BOOK} AS VARCHAR[]) AS skills FROM part), s AS (SELECT DISTINCT playbook, status, unnest(skills) AS skill FROM b) SELECT skill, count(*) AS playbooks, count(DISTINCT status) AS states, bool_or(status = 'active') AND bool_or(status = 'quarantined') AS conflict FROM s GROUP BY skill".replace("CAST(concat(", "CAST((concat(").replace("'\"]') AS VARCHAR[])", "'\"]'))::JSON AS VARCHAR[])"))
def m24(spark, d):
    b = fx.read(spark, d, "part").selectExpr("p_partkey AS playbook", f"{_STATE} AS status", f"{_BOOK} AS skills")
    s = b.select("playbook", "status", F.explode(F.array_distinct(F.from_json("skills", "array<string>"))).alias("skill"))
    return s.groupBy("skill").agg(F.count(F.lit(1)).alias("playbooks"), F.countDistinct("status").alias("states"), (F.bool_or(F.col("status") == "active") & F.bool_or(F.col("status") == "quarantined")).alias("conflict"))


@register("a31_experience_stats", f"WITH b AS (SELECT p_partkey AS playbook, {_STATE} AS status, p_brand AS scope, p_size % 5 AS success FROM part), o AS (SELECT CAST(l_partkey AS BIGINT) AS playbook, l_returnflag AS outcome FROM lineitem) SELECT status, outcome, count(*) AS n, count(DISTINCT playbook) AS playbooks FROM b JOIN o USING (playbook) WHERE scope IN (SELECT p_brand FROM part WHERE p_size > 45) GROUP BY 1, 2")
def a31(spark, d):
    p = fx.read(spark, d, "part")
    b = p.selectExpr("p_partkey AS playbook", f"{_STATE} AS status", "p_brand AS scope").join(p.where("p_size > 45").select(F.col("p_brand").alias("scope")), "scope", "left_semi")
    o = fx.read(spark, d, "lineitem").select(F.col("l_partkey").alias("playbook"), F.col("l_returnflag").alias("outcome"))
    return b.join(o, "playbook").groupBy("status", "outcome").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("playbook").alias("playbooks"))


@register("p21_record_access", fx.with_("memories", "asked") + f", a AS (SELECT query_id, scope_id AS own, 'src' || CAST((CAST(substr(scope_id, 4) AS BIGINT) + 1) % 20 AS VARCHAR) AS shared FROM asked) SELECT query_id, count(*) AS readable, count(CASE WHEN scope_id = own THEN 1 END) AS writable FROM memories, a WHERE {VISIBLE} AND (scope_id = own OR scope_id = shared AND target <> 'general') GROUP BY 1")
def p21(spark, d):
    m = fx.memories(spark, d).where(policy.ordinary_visible()).select("scope_id", "target")
    asked = fx.asked(spark, d).select("query_id", F.col("scope_id").alias("own"), F.concat(F.lit("src"), ((F.substring("scope_id", 4, 9).cast("long") + 1) % 20).cast("string")).alias("shared"))
    grants = asked.select("query_id", F.explode(F.array(F.struct(F.col("own").alias("scope_id"), F.lit(True).alias("writes")), F.struct(F.col("shared").alias("scope_id"), F.lit(False).alias("writes")))).alias("g")).select("query_id", "g.*")
    rows = m.groupBy("scope_id", "target").agg(F.count(F.lit(1)).alias("n")).join(grants, "scope_id").where("writes OR target <> 'general'")
    return rows.groupBy("query_id").agg(F.sum("n").alias("readable"), F.coalesce(F.sum(F.when(F.col("writes"), F.col("n"))), F.lit(0)).cast("long").alias("writable"))


@register("m7_candidate_review", fx.with_("memories") + f", r AS (SELECT id, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN 'promote' WHEN 1 THEN 'archive' ELSE 'supersede' END AS action, CAST(CAST(id AS BIGINT) + 1 AS VARCHAR) AS replacement, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN updated_at - INTERVAL '1' HOUR ELSE updated_at END AS expected_at FROM memories), v AS (SELECT id FROM memories WHERE {VISIBLE}) SELECT r.id, CASE WHEN {LIFE} <> 'candidate' THEN 'invalid_state' WHEN expected_at <> updated_at THEN 'conflict' WHEN action = 'promote' THEN 'promoted' WHEN action = 'archive' THEN 'archived' WHEN v.id IS NOT NULL THEN 'superseded' ELSE 'replacement_not_visible' END AS outcome FROM r JOIN memories m ON m.id = r.id LEFT JOIN v ON v.id = r.replacement")
def m7(spark, d):
    m = fx.memories(spark, d)
    n = F.col("id").cast("long")
    action = F.when(n % 3 == 0, "promote").when(n % 3 == 1, "archive").otherwise("supersede")
    at = F.when(n % 5 == 0, F.expr("updated_at - INTERVAL '1' HOUR")).otherwise(F.col("updated_at"))
    return govern.reviewed(m, m.select("id", action.alias("action"), (n + 1).cast("string").alias("replacement"), at.alias("expected_at")))


@register("q12_inspect", fx.with_("memories", "relations") + ", r AS (SELECT source_memory_id AS id, target_memory_id AS peer, relation_type, true AS out FROM relations UNION ALL SELECT target_memory_id, source_memory_id, relation_type, false FROM relations), s AS (SELECT r.*, left(m.summary, 40) AS shown FROM r JOIN memories m ON m.id = r.peer) SELECT id, peer, relation_type, out, rtrim(regexp_replace(trim(shown), '\\s+', ' ', 'g')) AS shown FROM s WHERE id IN (SELECT id FROM memories WHERE CAST(id AS BIGINT) % 50 = 0)")
def q12(spark, d):
    m = fx.memories(spark, d)
    asked = fx.every_50th(m).select("id")
    ends = graph.both_ends(fx.relations(spark, d)).join(asked, "id", "left_semi")
    shown = F.rtrim(F.regexp_replace(F.trim(F.left("summary", F.lit(40))), r"\s+", " "))
    return ends.join(m.select(F.col("id").alias("peer"), shown.alias("shown")), "peer").select("id", "peer", "relation_type", F.col("outgoing").alias("out"), "shown")


_NOW = "SELECT *, valid_to + (CAST(claim_id AS BIGINT) % 3) * INTERVAL '8' HOUR AS till FROM claims"


@register("a22_single_current_overlaps", fx.with_("claims") + f", c AS (SELECT scope_id, subject_key, predicate_key, claim_id, valid_from AS f, till AS t FROM ({_NOW})), b AS (SELECT DISTINCT y.scope_id, y.subject_key, y.predicate_key, y.claim_id FROM c x JOIN c y ON x.scope_id = y.scope_id AND x.subject_key = y.subject_key AND x.predicate_key = y.predicate_key AND (x.f < y.f OR x.f = y.f AND x.claim_id < y.claim_id) AND (x.t IS NULL OR x.t > y.f)), o AS (SELECT scope_id, subject_key, predicate_key, count(*) AS open FROM c WHERE t IS NULL GROUP BY 1, 2, 3) SELECT scope_id, subject_key, predicate_key, count(*) AS overlaps, coalesce(any_value(open), 0) AS open FROM b LEFT JOIN o USING (scope_id, subject_key, predicate_key) GROUP BY 1, 2, 3")
def a22(spark, d):
    c = fx.claims(spark, d).withColumn("valid_to", F.expr("valid_to + (CAST(claim_id AS BIGINT) % 3) * INTERVAL '8' HOUR")).withColumns({"status": F.lit("current"), "retired_at": F.lit(None).cast("timestamp")})
    return temporal.overlap_conflicts(c)


@register("k11_insert_checked", fx.with_("claims") + ", batch AS (SELECT claim_id || '-b' AS claim_id, scope_id, subject_key, predicate_key, valid_from - (CAST(claim_id AS BIGINT) % 40) * INTERVAL '1' DAY AS f, CASE WHEN CAST(claim_id AS BIGINT) % 2 = 0 THEN valid_from - (CAST(claim_id AS BIGINT) % 40) * INTERVAL '1' DAY + INTERVAL '6' HOUR END AS t FROM claims) SELECT claim_id, EXISTS (SELECT 1 FROM claims c WHERE c.scope_id = batch.scope_id AND c.subject_key = batch.subject_key AND c.predicate_key = batch.predicate_key AND NOT coalesce(t <= c.valid_from, false) AND NOT coalesce(c.valid_to <= f, false)) AS rejected FROM batch")
def k11(spark, d):
    c = fx.claims(spark, d)
    moved = "valid_from - (CAST(claim_id AS BIGINT) % 40) * INTERVAL '1' DAY"
    batch = c.withColumn("valid_to", F.expr(f"CASE WHEN CAST(claim_id AS BIGINT) % 2 = 0 THEN {moved} + INTERVAL '6' HOUR END")).withColumn("valid_from", F.expr(moved)).withColumn("claim_id", F.concat("claim_id", F.lit("-b")))
    return temporal.insert_checked(c, batch).select("claim_id", "rejected")


@register("q23_feedback_trust", "SELECT user_id, round(list_reduce(list_prepend(0.5e0, list(s ORDER BY ts, event_id)), lambda a, x: least(1e0, greatest(0e0, a + x))), 6) AS trust FROM (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 0.08e0 WHEN 'error' THEN -0.12e0 ELSE 0e0 END AS s FROM events) GROUP BY user_id")
def q23(spark, d):
    e = fx.read(spark, d, "events").select("user_id", "ts", "event_id", policy.mapped(F.col("event_type"), {"purchase": 0.08, "error": -0.12}, 0.0).alias("step"))
    return govern.trust(e, "user_id", ["ts", "event_id"]).select("user_id", F.round("trust", 6).alias("trust"))


_F, _U, _C = q(relations.FAILED), q(relations.UNSURE), q(relations.COMPLETE)


@register("n42_task_closure", f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations WHERE role IN ('assistant', 'tool')), t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS tail FROM o WHERE back <= 4 GROUP BY 1), b AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN regexp_matches(coalesce(tail, ''), '(?i){_F}') THEN 'failed' WHEN regexp_matches(coalesce(tail, ''), '(?i){_U}') THEN 'uncertain' WHEN regexp_matches(coalesce(tail, ''), '(?i){_C}') THEN 'success' WHEN regexp_matches(body, '(?i){_F}') THEN 'uncertain' ELSE 'unknown' END AS closure FROM b LEFT JOIN t USING (conv_id)")
def n42(spark, d):
    c = fx.read(spark, d, "conversations")
    order = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda s: s["text"]), "\n")
    body = c.groupBy("conv_id").agg(order(F.collect_list(F.struct("turn", "role", "text"))).alias("body"))
    last = recall.top(c.where(F.col("role").isin("assistant", "tool")), "conv_id", 4, F.desc("turn"), F.desc("role"), F.desc("text"))
    tail = last.groupBy("conv_id").agg(order(F.collect_list(F.struct("turn", "role", "text"))).alias("tail"))
    return body.join(tail, "conv_id", "left").select("conv_id", relations.closure(F.col("body"), F.coalesce("tail", F.lit(""))).alias("closure"))


@register("n36_memory_types", fx.with_("memories") + ", l AS (SELECT id, lower(content) AS low FROM memories) SELECT id, CASE WHEN regexp_matches(low, '\\b(prefer|prefers|like|likes|favorite)\\b') THEN 'preference' WHEN regexp_matches(low, '\\b(decided|decision|we will|agreed)\\b') THEN 'decision' WHEN regexp_matches(low, '\\b(deploy|deployed|release|restart)\\b') THEN 'procedure' WHEN regexp_matches(low, '\\b(error|failed|bug|pitfall|never)\\b') THEN 'pitfall' ELSE 'factual' END AS memory_type FROM l")
def n36t(spark, d):
    return fx.memories(spark, d).select("id", digest.classified(F.col("content")).alias("memory_type"))


@register("a32_replay_gain", fx.with_("notes") + ", g AS (SELECT n, list_filter(x, lambda t, i: list_position(x, t) = i) AS need FROM (SELECT n, regexp_extract_all(lower(split_part(content, chr(10), -1)), '[a-z]{4,}') AS x FROM notes)), "
    "c AS (SELECT o.scope_id, len(list_filter(need, lambda t: contains(lower(o.content), t))) / CAST(len(need) AS DOUBLE) AS a, len(list_filter(need, lambda t: contains(lower(coalesce(b.content, '')), t))) / CAST(len(need) AS DOUBLE) AS b FROM g JOIN notes o ON o.n = g.n - 2 LEFT JOIN notes b ON b.n = o.n - 1 WHERE len(need) > 0) "
    "SELECT scope_id, count(*) AS cases, round(avg(a), 6) AS coverage, round(avg(b), 6) AS baseline, round(avg(a - b), 6) AS gain, count(CASE WHEN a < b THEN 1 END) AS lost FROM c GROUP BY scope_id")
def a32(spark, d):
    """What a later note's words need, replayed against a note and against the one before it: either may cover more."""
    n = fx.notes(spark, d)
    need = F.array_distinct(F.regexp_extract_all(F.lower(F.substring_index("content", "\n", -1)), F.lit("[a-z]{4,}"), F.lit(0)))
    cases = n.select((F.col("n") - 2).alias("n"), need.alias("need")).where(F.size("need") > 0)
    cases = cases.join(n.select("n", "scope_id", "content"), "n").join(n.select((F.col("n") + 1).alias("n"), F.col("content").alias("base")), "n", "left")
    a, b = text.coverage(F.col("content"), F.col("need")), text.coverage(F.coalesce("base", F.lit("")), F.col("need"))
    return cases.groupBy("scope_id").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(a), 6).alias("coverage"), F.round(F.avg(b), 6).alias("baseline"), F.round(F.avg(a - b), 6).alias("gain"), F.count_if(a < b).alias("lost"))


_PACK = (
    BASE + BM25 + ", h1 AS (SELECT query_id, id, rank FROM best WHERE rank <= 6), fq AS (SELECT query_id, " + in_order(tok("left(content, 120)")) + "[1:12] AS ws FROM h1 JOIN corpus USING (id) WHERE rank = 1), qt2 AS (SELECT query_id, unnest(ws) AS term FROM fq), tf2 AS (SELECT id, term, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM qt2) GROUP BY 1, 2), df2 AS (SELECT term, count(*) AS df FROM tf2 GROUP BY term), "
    "bm2 AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS bm25 FROM tf2 JOIN df2 USING (term) JOIN dl USING (id) JOIN qt2 USING (term), total GROUP BY 1, 2), h2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, updated_at DESC, id) AS rank FROM bm2 JOIN corpus USING (id)), "
    "both_hops AS (SELECT query_id, id, 1 AS hop, rank FROM h1 UNION ALL SELECT query_id, id, 2, rank FROM h2 WHERE rank <= 6 AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.query_id = h2.query_id AND h1.id = h2.id)), facts AS (SELECT DISTINCT memory_id FROM claims WHERE status = 'current' AND retired_at IS NULL AND valid_from <= TIMESTAMP '2024-02-15 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-02-15 00:00:00')) "
)


@register("q21_evidence_pack", _PACK + "SELECT query_id, id, CASE WHEN f.memory_id IS NULL THEN 'memory' ELSE 'fact' END AS kind, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, rank) AS place FROM both_hops) LEFT JOIN facts f ON f.memory_id = id WHERE place <= 8")
def q21(spark, d):
    corpus, _ = stores_of(spark, d)
    facts = temporal.current(fx.claims(spark, d), fx.AS_OF).select(F.col("memory_id").alias("id")).distinct()
    return recall.evidence_pack(corpus.where(policy.ordinary_visible()), fx.asked(spark, d), facts).select("query_id", "id", "kind", "place")


@register("m15_scope_receipts", fx.with_("notes") + POSTED + ", fr AS (SELECT scope_id, e, count(DISTINCT id) AS df FROM po GROUP BY 1, 2), sz AS (SELECT scope_id, count(DISTINCT id) AS n FROM po GROUP BY 1), bl AS (SELECT scope_id, count(*) AS blocked FROM fr JOIN sz USING (scope_id) WHERE n >= 20 AND df >= greatest(12, ceil(0.03e0 * n)) GROUP BY 1), now AS (SELECT scope_id, max(n) AS revision, count(*) AS memories FROM notes GROUP BY 1), was AS (SELECT scope_id, max(n) AS revision FROM notes WHERE n % 50 <> 39 GROUP BY 1) SELECT now.scope_id, now.revision, memories, coalesce(blocked, 0) AS blocked, coalesce(was.revision = now.revision, false) AS valid FROM now LEFT JOIN was USING (scope_id) LEFT JOIN bl USING (scope_id)")
def m15(spark, d):
    n = fx.notes(spark, d)
    return relate.receipts(n, n.where("n % 50 <> 39"), "n")


@register("m30_reconciliation_state", fx.with_("outbox") + "SELECT generation_id, count(*) AS events, count(CASE WHEN status IN ('pending', 'claimed') THEN 1 END) AS open, count(CASE WHEN status = 'dead' THEN 1 END) AS dead, count(CASE WHEN status IN ('pending', 'claimed', 'dead') THEN 1 END) = 0 AS reconciled, strftime(max(CASE WHEN status = 'completed' THEN updated_at END) + INTERVAL '6' HOUR, '%Y-%m-%d %H:%M:%S') AS next_due FROM outbox GROUP BY 1")
def m30(spark, d):
    state = F.col("status")
    due = F.max(F.when(state == "completed", F.col("updated_at"))) + F.expr("INTERVAL '6' HOUR")
    return fx.outbox(spark, d).groupBy("generation_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(state.isin("pending", "claimed")).alias("open"), F.count_if(state == "dead").alias("dead"),
        (F.count_if(state.isin("pending", "claimed", "dead")) == 0).alias("reconciled"), stamp(due).alias("next_due"),
    )


@register("k17_ngram_generation", fx.with_("notes") + ", r AS (SELECT id, unnest(regexp_extract_all(content || chr(10) || summary, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]+')) AS r FROM notes), g AS (SELECT DISTINCT id, substr(r, i, n) AS gram FROM (SELECT *, unnest(generate_series(1, length(r) - n + 1)) AS i FROM r, (SELECT unnest([2, 3]) AS n) WHERE length(r) >= n)) SELECT gram, count(*) AS df, min(id) AS first FROM g GROUP BY gram")
def k17(spark, d):
    runs = F.regexp_extract_all(F.concat_ws("\n", "content", "summary"), F.lit(text.CJK_RUN), F.lit(0))
    grams = fx.notes(spark, d).select("id", F.explode(runs).alias("r")).select("id", F.explode(F.concat(text.ngrams(F.col("r"), 2), text.ngrams(F.col("r"), 3))).alias("gram")).distinct()
    index = written(grams.repartition("gram"), f"{folder(spark)}/generation=1")
    return index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("first"))


@register("s4_curated_entries", fx.with_("memories") + ", e AS (SELECT target AS file, trim(replace(content, chr(10), ' ')) AS c FROM memories WHERE source = 'builtin-curated' AND NOT contains(content, '§')) SELECT file, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS characters FROM e WHERE c <> '' GROUP BY file")
def s4(spark, d):
    m = fx.memories(spark, d).where("source = 'builtin-curated'").where(~F.contains("content", F.lit(files.DELIMITER)))
    path = folder(spark)
    flat = F.trim(F.replace("content", F.lit("\n"), F.lit(" ")))
    m.select("target", F.concat(F.lit(files.DELIMITER + "\n"), flat).alias("value")).write.partitionBy("target").text(path)
    found = files.curated_entries(spark, path)
    return found.groupBy(F.regexp_extract("path", "target=([^/]+)", 1).alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("content").cast("long")).alias("characters"))


_WORDS = f"(SELECT id, list(DISTINCT u) AS ws FROM (SELECT id, unnest([t, {STEM}]) AS u FROM (SELECT id, unnest({tok('content')}) AS t FROM memories)) GROUP BY id)"


@register("j21_best_match", fx.with_("memories") + f", w AS (SELECT id, list(DISTINCT cu) AS ws FROM (SELECT id, coalesce((MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in text.ALIASES.items())}}})[u], u) AS cu FROM (SELECT id, unnest([t, {STEM}]) AS u FROM (SELECT id, unnest({tok('content')}) AS t FROM memories))) GROUP BY id), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY updated_at DESC, id) AS r FROM memories WHERE {VISIBLE}) WHERE r <= 250), "
    "p AS (SELECT c.id AS candidate_id, k.id, CASE WHEN c.dedup_key = k.dedup_key THEN 1e0 WHEN wc.id IS NULL OR wk.id IS NULL THEN 0e0 ELSE greatest(len(list_intersect(wc.ws, wk.ws)) / CAST(len(wc.ws) + len(wk.ws) - len(list_intersect(wc.ws, wk.ws)) AS DOUBLE), 0.82e0 * len(list_intersect(wc.ws, wk.ws)) / least(len(wc.ws), len(wk.ws))) END AS s FROM memories c JOIN k USING (target) LEFT JOIN w wc ON wc.id = c.id LEFT JOIN w wk ON wk.id = k.id WHERE CAST(c.id AS BIGINT) % 50 = 0), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY round(s, 9) DESC, id DESC) AS r FROM p) SELECT candidate_id, id AS match_id, round(s, 6) AS score, CASE WHEN s >= 0.88 THEN 'skip' WHEN s >= 0.55 THEN 'review' ELSE 'insert' END AS action FROM b WHERE r = 1")
def j21(spark, d):
    m = fx.memories(spark, d)
    found = fx.every_50th(m).select(F.col("id").alias("candidate_id"), "target", F.col("content").alias("candidate"), "dedup_key")
    return digest.best_match(found, m).select("candidate_id", "match_id", F.round("score", 6).alias("score"), "action")


_EVENT = "CASE n % 5 WHEN 0 THEN 'user_correction' WHEN 1 THEN 'task_closeout' WHEN 2 THEN 'session_end' WHEN 3 THEN 'release_closeout' ELSE 'chatter' END"
_SAN = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '{q(text.DATA_URL)}', ' ', 'g'), '{q(text.ATTACHMENT)}', '', 'g'), '(?i)\\b(api[_-]?key|token|secret|password|passwd|private[_-]?key)\\s*[:=]\\s*[^\\s]+', '\\1=[REDACTED]', 'g'), '{q(text.PRIVATE_PATH)}', '\\1[REDACTED_PATH]', 'g'))"


@register("m8_event_candidates", fx.with_("notes") + f", p AS (SELECT id, {_EVENT} AS kind, rtrim(left({_SAN}, 4000)) AS c, regexp_matches(content, '{q(text.SECRET)}') AS secret FROM notes), g AS (SELECT * FROM p WHERE kind <> 'chatter' AND NOT secret AND length(c) >= 16 AND NOT regexp_matches(c, '{q(govern.EPHEMERAL)}') AND (NOT regexp_matches(c, '{q(govern.LOW_VALUE)}') OR regexp_matches(c, '{q(govern.USER_WISH)}'))), "
    f"t AS (SELECT id, c, CASE WHEN regexp_matches(c, '{q(govern.USER_WISH)}') THEN 'user' WHEN regexp_matches(c, '{q(govern.OPERATIONS)}') THEN 'ops' WHEN regexp_matches(c, '{q(govern.PROJECTS)}') THEN 'project' END AS target FROM g) SELECT min(id) AS id, target, CASE target WHEN 'user' THEN 0.78e0 WHEN 'ops' THEN 0.68e0 ELSE 0.66e0 END AS confidence FROM t WHERE target IS NOT NULL GROUP BY target, regexp_replace(lower(trim(c)), '\\s+', ' ', 'g')")
def m8(spark, d):
    events = fx.notes(spark, d).selectExpr("id", f"{_EVENT} AS kind", "content")
    return govern.event_candidates(govern.packets(events)).select("id", "target", "confidence")


@register("m5_stored_memories", fx.with_("memories") + f", b AS (SELECT scope_id, target, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN dedup_key ELSE 'new ' || dedup_key END AS dedup_key, 'b' || id AS id FROM memories), f AS (SELECT scope_id, target, dedup_key, min(id) AS id FROM b GROUP BY 1, 2, 3) SELECT m.id, CASE WHEN f.id IS NOT NULL AND {VISIBLE} THEN '2024-03-01 00:00:00' ELSE {TS.format('updated_at')} END AS updated FROM memories m LEFT JOIN f USING (scope_id, target, dedup_key) UNION ALL SELECT f.id, '2024-03-01 00:00:00' FROM f WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.scope_id = f.scope_id AND m.target = f.target AND m.dedup_key = f.dedup_key AND {VISIBLE})")
def m5(spark, d):
    m = fx.memories(spark, d)
    n = F.col("id").cast("long")
    at = F.lit("2024-03-01 00:00:00").cast(m.schema["updated_at"].dataType)
    batch = m.withColumn("dedup_key", F.when(n % 2 == 0, F.col("dedup_key")).otherwise(F.concat(F.lit("new "), "dedup_key"))).withColumns({"id": F.concat(F.lit("b"), "id"), "updated_at": at})
    return govern.stored(m, batch, "2024-03-01 00:00:00").select("id", stamp("updated_at").alias("updated"))


_ENTRY = "SELECT event_id AS entry_id, CASE WHEN event_id % 3 > 0 THEN concat('run-', CAST(user_id % 9 AS {s})) END AS run_id FROM events"
_REJ = "SELECT event_id - event_id % 4 AS entry_id, concat('run-', CAST(user_id % 9 AS {s})) AS run_id, concat(CASE event_type WHEN 'click' THEN 'llm_error:' WHEN 'view' THEN 'quality:' ELSE 'duplicate:' END, CAST(event_id % 5 AS {s})) AS reason, ts AS {at} FROM events"


@register("j19_recovery", f"WITH e AS ({_ENTRY.format(s='VARCHAR')}), r AS ({_REJ.format(s='VARCHAR', at='seen')}), l AS (SELECT *, row_number() OVER (PARTITION BY entry_id, run_id ORDER BY seen DESC, reason DESC) AS n FROM r) SELECT entry_id, reason FROM e JOIN l USING (entry_id, run_id) WHERE n = 1 AND (reason LIKE 'llm_error%' OR reason LIKE 'quality:%') AND entry_id NOT IN (SELECT event_id FROM events WHERE user_id % 6 = 0)")
def j19(spark, d):
    e = fx.read(spark, d, "events")
    entries = e.selectExpr("event_id AS entry_id", "CASE WHEN event_id % 3 > 0 THEN concat('run-', CAST(user_id % 9 AS STRING)) END AS run_id")
    rejections = e.selectExpr("event_id - event_id % 4 AS entry_id", "concat('run-', CAST(user_id % 9 AS STRING)) AS run_id", "concat(CASE event_type WHEN 'click' THEN 'llm_error:' WHEN 'view' THEN 'quality:' ELSE 'duplicate:' END, CAST(event_id % 5 AS STRING)) AS reason", "ts AS at")
    return govern.replayable(entries, rejections, e.where("user_id % 6 = 0").select(F.col("event_id").alias("entry_id")), ("llm_error", "quality:"))


@register("m27_grounded_sentences", fx.with_("notes") + f", c AS (SELECT id, summary, [id, CAST(CAST(id AS BIGINT) + 20 AS VARCHAR)] AS cited FROM notes WHERE NOT regexp_matches(content, '[\\x{{4e00}}-\\x{{9fff}}]')), a AS (SELECT id, list_filter(list_distinct({tok('summary')}), lambda t: NOT list_contains({listed((*text.SEMANTIC_STOPWORDS, *text.CJK_STOPWORDS))}, t)) AS asked, unnest(cited) AS ev FROM c), u AS (SELECT id, list(DISTINCT u) AS known FROM (SELECT id, unnest([t, {STEM}]) AS u FROM (SELECT id, unnest({tok('content')}) AS t FROM notes WHERE n % 3 <> 0)) GROUP BY id), "
    "s AS (SELECT a.id, max(CASE WHEN known IS NULL OR len(asked) = 0 THEN 0e0 ELSE len(list_intersect(asked, known)) / CAST(len(asked) AS DOUBLE) END) AS share FROM a LEFT JOIN u ON u.id = a.ev GROUP BY 1) SELECT id AS claim_id, round(share, 6) AS share, share >= 0.6 AS grounded FROM s")
def m27(spark, d):
    n = fx.notes(spark, d)
    claims = n.where(~F.col("content").rlike(r"[\x{4e00}-\x{9fff}]")).select(F.col("id").alias("claim_id"), F.col("summary").alias("sentence"), F.array("id", (F.col("id").cast("long") + 20).cast("string")).alias("cited"))
    found = govern.grounded(claims, n.where("n % 3 <> 0").select(F.col("id").alias("evidence_id"), "content"))
    return found.select("claim_id", F.round("share", 6).alias("share"), "grounded")


@register("m25_playbook_anchors", fx.with_("journal") + ", k AS (SELECT session_id, turn_number, content, CASE WHEN role = 'user' THEN 'user_statement' WHEN regexp_matches(content, '(?i)\\b(?:pytest|ruff|pyright)\\b') THEN 'test_command' WHEN regexp_matches(content, '(?i)\\b(?:doctor|health check|release gate|smoke)\\b') THEN 'health_report' WHEN regexp_matches(content, '(?i)\\b(?:git\\s+status|git\\s+diff|pull request|PR|issue\\s*#?\\d+)\\b') THEN 'repo_state' WHEN role = 'assistant' AND regexp_matches(content, '(?i)完成|通过|success|fixed|done|passed') THEN 'assistant_closure' END AS kind FROM journal WHERE role IN ('user', 'assistant', 'tool')), "
    f"f AS (SELECT session_id, kind, left({_SAN}, 260) AS said, min(turn_number) AS turn FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, kind, said) AS n FROM f) SELECT session_id, count(*) AS anchors, count(CASE WHEN kind = 'user_statement' THEN 1 END) AS stated, bool_or(kind IN ('test_command', 'health_report')) AS verified FROM r WHERE n <= 8 GROUP BY 1")
def m25(spark, d):
    return govern.synthesis(fx.journal(spark, d))


@register("o9_bounded_scan", fx.with_("claims") + "SELECT claim_id FROM claims WHERE subject_key = 'user:7' AND status = 'current'")
def o9(spark, d):
    mine = fx.claims(spark, d).where("subject_key = 'user:7' AND status = 'current'")
    return temporal.bounded(mine, 10_000).select("claim_id")


_META = (
    "CASE WHEN n % 17 = 0 THEN '{broken' ELSE concat('{\"lifecycle\": \"', CASE n % 3 WHEN 0 THEN 'candidate' ELSE 'promoted' END, '\", \"memory_type\": \"', CASE n % 7 WHEN 0 THEN 'factual' WHEN 1 THEN 'preference' WHEN 2 THEN 'summary' WHEN 3 THEN 'project' WHEN 4 THEN 'workflow' WHEN 5 THEN '' ELSE 'odd' END, "
    "'\", \"confidence\": 0.', CAST(n % 9 + 1 AS STRING), ', \"importance\": 0.', CAST(n % 8 + 1 AS STRING), CASE WHEN n % 4 = 0 THEN ', \"expires_at\": \"stale-review\"' ELSE '' END, CASE WHEN n % 5 <> 0 THEN ', \"evidence_refs\": [\"e1\"]' ELSE '' END, CASE WHEN n % 11 = 0 THEN ', \"sensitivity\": \"secret_reference\"' ELSE '' END, '}') END"
)


def judged(spark, d):
    return fx.notes(spark, d).withColumn("metadata", F.expr(_META))


_J = "CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.{}') END"
_LOW = "lower(summary || chr(10) || content)"


def _any(words) -> str:
    return "(" + " OR ".join(f"contains({_LOW}, '{w}')" for w in words) + ")"


_SNAP = f"len(list_filter(regexp_split_to_array(summary || chr(10) || content, '[。！？!?;；\\n]+'), lambda x: regexp_matches(x, '{q(evidence.CURRENT)}') AND regexp_matches(x, '{q(evidence.VOLATILE)}') AND NOT regexp_matches(x, '{q(evidence.NORMATIVE)}'))) > 0"
_RULES = {
    "cache_or_tmp_path": _any(reports.CACHE_PATHS),
    "stale_status_snapshot": f"source IN ('journal-digest', 'nightly-digest') AND ({_any(reports.STALE_TERMS)} OR {_SNAP})",
    "stale_review_active": f"coalesce({_J.format('expires_at')}, '') = 'stale-review'",
    "missing_memory_type": f"coalesce({_J.format('memory_type')}, '') = ''",
    "secret_like_content": f"regexp_matches(content, '{q(text.SECRET)}')",
    "secret_reference_missing_vault_ref": f"coalesce({_J.format('sensitivity')}, '') = 'secret_reference'",
    "template_prefix": "content LIKE 'Journal digest memory%' OR content LIKE 'Operations workflow summary%'",
    "raw_attachment_marker": _any(reports.ATTACHMENT_MARKERS),
    "artifact_anchor_marker": f"contains({_LOW}, 'artifact anchors:')",
    "redacted_path_marker": f"contains({_LOW}, '[redacted_path]')",
    "overlong_transcript": "length(content) >= 900 AND marks >= 2 OR length(content) >= 2400 AND marks >= 1",
}
_MARKS = " + ".join(f"CAST(contains(lower(content), '{w}') AS INT)" for w in reports.TRANSCRIPT_MARKERS)
_LINT = (
    fx.with_("notes") + f", nm AS (SELECT * REPLACE ({_META.replace('STRING', 'VARCHAR')} AS metadata), {_MARKS} AS marks FROM notes), st AS (SELECT *, lower(coalesce({_J.format('lifecycle')}, '')) AS life FROM nm), "
    + "br AS (" + " UNION ALL ".join(f"SELECT id, '{name}' AS rule FROM st WHERE life IN ('', 'promoted') AND ({rule})" for name, rule in _RULES.items()) + ") "
)
_DECIDED = (
    ", rl AS (SELECT id, string_agg(rule, ',' ORDER BY rule) AS rules FROM br GROUP BY id), "
    f"dv AS (SELECT st.*, rules, coalesce({_J.format('memory_type')}, '') AS kind, coalesce(CAST({_J.format('confidence')} AS DOUBLE), 0) AS sure, coalesce(CAST({_J.format('importance')} AS DOUBLE), 0) AS weight, coalesce({_J.format('evidence_refs')}, '') <> '' AS backed FROM st LEFT JOIN rl USING (id)), "
    f"rs AS (SELECT *, CASE WHEN life <> 'candidate' THEN CASE WHEN rules IS NOT NULL THEN 'active_lint_rules:' || rules ELSE 'not_candidate' END WHEN target NOT IN ('user', 'memory', 'project', 'ops') THEN 'target_not_profile_surface' WHEN regexp_matches(content, '{q(text.SECRET)}') THEN 'secret_like_content_requires_human_review' WHEN coalesce({_J.format('expires_at')}, '') = 'stale-review' THEN 'stale_review_requires_operator_review' WHEN {_any(reports.REVIEW_TERMS)} THEN 'high_risk_terms_require_human_review' WHEN kind = 'summary' THEN 'low_value_memory_type:summary' WHEN {_any(reports.PROGRESS_TERMS)} AND kind = 'project' THEN 'stale_progress_or_release_status' "
    "WHEN kind NOT IN ('factual', 'preference', 'project', 'workflow') THEN 'unsupported_memory_type:' || CASE kind WHEN '' THEN 'unknown' ELSE kind END WHEN NOT backed THEN 'missing_evidence_anchor' WHEN target = 'user' AND sure >= 0.78 THEN 'user_profile_candidate_confident' WHEN sure >= 0.78 AND weight >= 0.55 THEN 'high_confidence_stable_candidate' WHEN weight >= 0.82 AND sure >= 0.62 THEN 'high_importance_stable_candidate' ELSE 'below_auto_promotion_threshold' END AS reason FROM dv), "
    "de AS (SELECT *, CASE WHEN reason = 'not_candidate' THEN 'skip' WHEN reason LIKE 'active%' THEN 'needs_review' WHEN reason LIKE 'low_value%' OR reason LIKE 'stale_progress%' THEN 'archive' WHEN reason LIKE '%_confident' OR reason LIKE '%stable_candidate' THEN 'promote' ELSE 'keep_candidate' END AS action, CASE WHEN reason LIKE '%human_review' OR reason LIKE 'active%secret_like_content%' THEN 'high' WHEN reason LIKE 'active%' OR reason LIKE 'stale_review%' OR reason = 'missing_evidence_anchor' THEN 'medium' ELSE 'low' END AS risk FROM rs) "
)


@register("a15_quality_lint", _LINT + "SELECT * FROM br")
def a15(spark, d):
    return reports.quality_rules(judged(spark, d))


@register("a16_quality_decisions", _LINT + _DECIDED + "SELECT action, risk, reason, count(*) AS n FROM de GROUP BY 1, 2, 3")
def a16(spark, d):
    return reports.quality_decisions(judged(spark, d)).groupBy("action", "risk", "reason").agg(F.count(F.lit(1)).alias("n"))


@register("a17_candidate_debt", _LINT + _DECIDED + f"SELECT action, CASE WHEN action = 'promote' THEN 'promote_safe' WHEN action = 'archive' THEN 'archive_low_value' WHEN action = 'skip' THEN 'skip' WHEN risk = 'high' THEN 'needs_review_high_risk' WHEN reason = 'below_auto_promotion_threshold' THEN 'defer_recent' ELSE 'needs_review' END AS lane, target, source, count(*) AS n, {TS.format('min(updated_at)')} AS oldest, {TS.format('max(updated_at)')} AS newest FROM de WHERE life = 'candidate' GROUP BY 1, 2, 3, 4")
def a17(spark, d):
    rows = reports.quality_decisions(judged(spark, d).where(policy.lifecycle() == "candidate")).withColumn("lane", reports.lane())
    return rows.groupBy("action", "lane", "target", "source").agg(F.count(F.lit(1)).alias("n"), stamp(F.min("updated_at")).alias("oldest"), stamp(F.max("updated_at")).alias("newest"))


_C = {"life": f"lower(coalesce({_J.format('lifecycle')}, ''))", "flag": f"coalesce({_J.format('event_digest')}, '')", "status": f"lower(coalesce({_J.format('candidate_status')}, ''))"}
_CANDIDATES = "CASE WHEN n % 17 = 0 THEN '{broken' ELSE concat('{\"lifecycle\": \"', CASE n % 6 WHEN 0 THEN 'Candidate' WHEN 1 THEN '' WHEN 2 THEN 'promoted' WHEN 3 THEN 'candidate' ELSE 'scratch' END, '\"', CASE WHEN n % 5 = 1 THEN ', \"event_digest\": true' ELSE '' END, CASE WHEN n % 7 = 3 THEN ', \"candidate_status\": \"archived\"' ELSE '' END, '}') END"
_SOURCES = "CASE WHEN n % 8 = 1 THEN 'event-digest' ELSE source END"


@register("p4_candidates", fx.with_("notes") + f", c AS (SELECT * REPLACE ({_CANDIDATES} AS metadata, {_SOURCES} AS source) FROM notes) SELECT id FROM c WHERE ({_C['life']} = 'candidate' OR (source IN ('event-digest', 'memory-candidate') OR {_C['flag']} = 'true') AND {_C['life']} IN ('', 'candidate')) AND {_C['life']} NOT IN ('promoted', 'archived', 'rejected', 'superseded', 'obsolete', 'in_progress') AND {_C['status']} NOT IN ('promoted', 'archived', 'rejected', 'superseded', 'obsolete', 'in_progress')")
def p4(spark, d):
    n = fx.notes(spark, d).withColumns({"metadata": F.expr(_CANDIDATES), "source": F.expr(_SOURCES)})
    return n.where(policy.is_candidate()).select("id")


#: What is left of the memories when the ops rows are gone, and whether the rest is hidden.
_LEFT = f"(SELECT id, target, {LIFE} IN ('archived', 'obsolete', 'rejected', 'superseded', 'candidate', 'scratch', 'in_progress') AS hidden FROM memories WHERE target <> 'ops')"


@register("j6_orphans", fx.with_("memories", "relations", "claims", "freshness", "notes") + POSTED + f", lf AS {_LEFT}, w AS (SELECT DISTINCT id FROM (SELECT id, unnest({tok('content')}) AS t FROM notes)) SELECT 'relations' AS part, count(*) AS rows, count(CASE WHEN s.id IS NULL OR t.id IS NULL THEN 1 END) AS orphans, count(CASE WHEN s.hidden OR t.hidden THEN 1 END) AS hidden FROM relations r LEFT JOIN lf s ON s.id = r.source_memory_id LEFT JOIN lf t ON t.id = r.target_memory_id "
    "UNION ALL SELECT 'entities', count(*), count(CASE WHEN lf.id IS NULL THEN 1 END), count(CASE WHEN lf.hidden THEN 1 END) FROM po LEFT JOIN lf USING (id) UNION ALL SELECT 'claims', count(*), count(CASE WHEN lf.id IS NULL THEN 1 END), count(CASE WHEN lf.hidden THEN 1 END) FROM claims LEFT JOIN lf ON lf.id = memory_id "
    "UNION ALL SELECT 'freshness', count(*), count(CASE WHEN lf.id IS NULL THEN 1 END), count(CASE WHEN lf.hidden THEN 1 END) FROM freshness LEFT JOIN lf USING (id) UNION ALL SELECT 'index', count(*), count(CASE WHEN lf.id IS NULL THEN 1 END), count(CASE WHEN lf.hidden THEN 1 END) FROM w LEFT JOIN lf USING (id)")
def j6(spark, d):
    left = fx.memories(spark, d).where("target <> 'ops'").select("id", policy.lifecycle().isin(*policy.ORDINARY_HIDDEN).alias("hidden"))
    n = fx.notes(spark, d)
    index = recall.postings(n).where("term <> ''").select("id").distinct()
    parts = {"relations": (fx.relations(spark, d), ["source_memory_id", "target_memory_id"]), "entities": (relate.postings(n), ["memory_id"]), "claims": (fx.claims(spark, d), ["memory_id"]), "freshness": (fx.freshness(spark, d), ["id"]), "index": (index, ["id"])}
    return reports.orphans(left, parts)


@register("k3_cascade_delete", fx.with_("memories", "relations", "claims", "freshness", "notes") + POSTED + ", dm AS (SELECT id FROM memories WHERE target = 'ops') SELECT 'relations' AS part, count(*) AS rows FROM relations WHERE source_memory_id NOT IN (SELECT id FROM dm) AND target_memory_id NOT IN (SELECT id FROM dm) UNION ALL SELECT 'entities', count(*) FROM po WHERE id NOT IN (SELECT id FROM dm) UNION ALL SELECT 'claims', count(*) FROM claims WHERE memory_id NOT IN (SELECT id FROM dm) UNION ALL SELECT 'freshness', count(*) FROM freshness WHERE id NOT IN (SELECT id FROM dm) UNION ALL SELECT 'memories', count(*) FROM memories WHERE id NOT IN (SELECT id FROM dm)")
def k3(spark, d):
    m = fx.memories(spark, d)
    n = fx.notes(spark, d)
    left = scan.cascade(m.where("target = 'ops'"), {"relations": (fx.relations(spark, d), ["source_memory_id", "target_memory_id"]), "entities": (relate.postings(n), ["memory_id"]), "claims": (fx.claims(spark, d), ["memory_id"]), "freshness": (fx.freshness(spark, d), ["id"]), "memories": (m, ["id"])})
    out = [rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows") for name, rows in left.items()]
    return reports.stacked(out)


@register("s5_session_bundles", "WITH m AS (SELECT user_id, event_id, event_type AS role, ts FROM events WHERE ts >= TIMESTAMP '2024-01-14 23:00:00' AND ts < TIMESTAMP '2024-01-15 23:00:00') SELECT user_id, count(*) AS n, string_agg(role, ',' ORDER BY event_id) AS roles, max(event_id) AS last FROM m GROUP BY 1")
def s5(spark, d):
    e = fx.read(spark, d, "events").withColumnRenamed("event_type", "role")
    b = scan.day_bundles(e, "2024-01-15", "Europe/Berlin", "user_id", "ts", "event_id", "role", "tool_name")
    return b.select("user_id", "n", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.array_max(F.transform("messages", lambda m: m["event_id"])).alias("last"))


@register("j17_freshness_report", fx.with_("memories", "freshness") + f", k AS (SELECT m.id, coalesce({_J.format('memory_type')}, '') IN ('factual', 'project', '') AS cohort FROM memories m WHERE {LIFE} NOT IN ('archived', 'obsolete', 'rejected', 'superseded')) SELECT status, truth_type, count(*) AS n, count(CASE WHEN cohort THEN 1 END) AS factual, count(CASE WHEN status IN ('needs_live_check', 'expired') THEN 1 END) AS to_check FROM freshness JOIN k USING (id) GROUP BY 1, 2")
def j17(spark, d):
    kind = F.coalesce(policy.json_text("metadata", "$.memory_type"), F.lit(""))
    m = fx.memories(spark, d).where(policy.durable_visible()).select("id", kind.isin("factual", "project", "").alias("cohort"))
    rows = fx.freshness(spark, d).join(m, "id")
    return rows.groupBy("status", "truth_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("cohort").alias("factual"), F.count_if(F.col("status").isin("needs_live_check", "expired")).alias("to_check"))


@register("j18_digest_lineage", f"WITH e AS ({_ENTRY.format(s='VARCHAR')}), r AS ({_REJ.format(s='VARCHAR', at='seen')}), d AS (SELECT DISTINCT run_id, CASE WHEN run_id IN ('run-0', 'run-3', 'run-6') THEN 'llm-quarantine' ELSE 'heuristic' END AS extractor FROM e WHERE run_id IS NOT NULL), s AS (SELECT event_id AS entry_id FROM events WHERE user_id % 6 = 0) SELECT d.run_id, extractor, count(*) AS rejected, count(CASE WHEN s.entry_id IS NULL AND reason LIKE 'llm_error:%' THEN 1 END) AS unresolved FROM d JOIN e USING (run_id) JOIN r ON r.entry_id = e.entry_id AND r.run_id = d.run_id LEFT JOIN s ON s.entry_id = e.entry_id GROUP BY 1, 2")
def j18(spark, d):
    e = fx.read(spark, d, "events")
    entries = e.selectExpr("event_id AS entry_id", "CASE WHEN event_id % 3 > 0 THEN concat('run-', CAST(user_id % 9 AS STRING)) END AS run_id").where("run_id IS NOT NULL")
    rejections = e.selectExpr("event_id - event_id % 4 AS entry_id", "concat('run-', CAST(user_id % 9 AS STRING)) AS run_id", "concat(CASE event_type WHEN 'click' THEN 'llm_error:' WHEN 'view' THEN 'quality:' ELSE 'duplicate:' END, CAST(event_id % 5 AS STRING)) AS reason")
    runs = entries.select("run_id").distinct().withColumn("extractor", F.when(F.col("run_id").isin("run-0", "run-3", "run-6"), "llm-quarantine").otherwise("heuristic"))
    sources = e.where("user_id % 6 = 0").select(F.col("event_id").alias("entry_id"), F.lit(True).alias("kept"))
    rows = runs.join(entries, "run_id").join(rejections, ["entry_id", "run_id"]).join(sources, "entry_id", "left")
    return rows.groupBy("run_id", "extractor").agg(F.count(F.lit(1)).alias("rejected"), F.count_if(F.col("kept").isNull() & F.col("reason").startswith("llm_error:")).alias("unresolved"))


@register("a33_graph_stats", fx.with_("memories", "relations") + f", lf AS {_LEFT}, x AS (SELECT r.*, s.id IS NULL OR t.id IS NULL AS orphan, coalesce(s.hidden, false) OR coalesce(t.hidden, false) AS hid, ms.scope_id = mt.scope_id AS same FROM relations r LEFT JOIN lf s ON s.id = r.source_memory_id LEFT JOIN lf t ON t.id = r.target_memory_id LEFT JOIN memories ms ON ms.id = r.source_memory_id LEFT JOIN memories mt ON mt.id = r.target_memory_id) SELECT relation_type, count(*) AS relations, count(DISTINCT source_memory_id) AS sources, count(CASE WHEN orphan THEN 1 END) AS orphans, count(CASE WHEN hid THEN 1 END) AS hidden_peers, count(CASE WHEN same THEN 1 END) AS scoped FROM x GROUP BY 1")
def a33(spark, d):
    m = fx.memories(spark, d)
    left = m.select("id", "scope_id", (F.col("target") != "ops").alias("there"), policy.lifecycle().isin(*policy.ORDINARY_HIDDEN).alias("hidden"))
    return reports.graph_stats(left, fx.relations(spark, d))


@register("q17_forgetting_run", fx.with_("memories") + f", k AS (SELECT scope_id, target, dedup_key, min((created_at, id)) AS first FROM memories WHERE {LIFE} <> 'archived' AND dedup_key <> '' GROUP BY 1, 2, 3), x AS (SELECT m.id, {LIFE} AS life, CASE WHEN {LIFE} = 'archived' THEN NULL WHEN regexp_matches(content, '{q(text.SECRET)}') OR regexp_matches(content, '{q(reports.WRAPPER_NOISE)}') THEN 'hard' WHEN m.target = 'general' AND m.source = 'turn-assistant' OR length(trim(content)) <= 24 OR coalesce((m.created_at, m.id) <> k.first, false) THEN 'soft' WHEN {LIFE} = 'candidate' THEN 'review' END AS action FROM memories m LEFT JOIN k USING (scope_id, target, dedup_key)) SELECT id, CASE WHEN action = 'soft' THEN 'archived' ELSE life END AS lifecycle, coalesce(action, 'keep') AS action FROM x WHERE action IS DISTINCT FROM 'hard'")
def q17(spark, d):
    m = fx.memories(spark, d)
    plan = reports.forgetting(m)
    rows = scan.delete(m, plan.where("action = 'hard'"), "id").join(plan.select("id", "action"), "id", "left")
    return rows.select("id", F.when(F.col("action") == "soft", "archived").otherwise(policy.lifecycle()).alias("lifecycle"), F.coalesce("action", F.lit("keep")).alias("action"))


_EDIT = "CASE WHEN n % 10 = 0 THEN concat('Now svc-new replaces svc-', CAST(n % 50 AS STRING)) ELSE content END"


@register("k2_updated_companions", fx.with_("notes") + f", nu AS (SELECT id, n, {_EDIT.replace('STRING', 'VARCHAR')} AS content, CASE WHEN n % 10 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE updated_at END AS updated_at FROM notes)" + entity_cte("en", "id", raw_entities("content"), "nu") + f", po AS (SELECT id, e FROM (SELECT id, unnest(es) AS e FROM en) WHERE {_DISTINCTIVE}) SELECT nu.id, {TS.format('any_value(updated_at)')} AS updated, sha256(any_value(content)) AS content, count(e) AS entities, coalesce(max(e), '') AS last FROM nu LEFT JOIN po USING (id) GROUP BY nu.id")
def k2(spark, d):
    n = fx.notes(spark, d)
    changes = n.where("n % 10 = 0").select("id", F.expr(_EDIT).alias("content"))
    state = govern.updated(n, changes, "2024-03-01 00:00:00")
    posted = govern.companions(relate.postings(n), changes, relate.postings(state))
    counts = posted.groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("entities"), F.max("entity").alias("last"))
    return state.join(counts, "id", "left").select("id", stamp("updated_at").alias("updated"), F.sha2("content", 256).alias("content"), F.coalesce("entities", F.lit(0)).cast("long").alias("entities"), F.coalesce("last", F.lit("")).alias("last"))


@register("a28_stats_dashboard", fx.with_("memories", "relations", "claims", "vectors", "outbox") + f"SELECT metric, CAST(n AS BIGINT) AS n FROM (SELECT 'rows' AS metric, count(*) AS n FROM memories UNION ALL SELECT 'scopes', count(DISTINCT scope_id) FROM memories UNION ALL SELECT 'visible', count(CASE WHEN {VISIBLE} THEN 1 END) FROM memories UNION ALL SELECT 'invalid_metadata', count(CASE WHEN NOT json_valid(metadata) THEN 1 END) FROM memories UNION ALL SELECT 'characters', sum(length(content)) FROM memories UNION ALL SELECT 'lifecycle:' || {LIFE}, count(*) FROM memories GROUP BY {LIFE} UNION ALL SELECT 'target:' || target, count(*) FROM memories GROUP BY target "
    "UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'relation:' || relation_type, count(*) FROM relations GROUP BY relation_type UNION ALL SELECT 'claims', count(*) FROM claims UNION ALL SELECT 'subjects', count(DISTINCT subject_key) FROM claims UNION ALL SELECT 'vectors', count(*) FROM vectors UNION ALL SELECT 'outbox:' || status, count(*) FROM outbox GROUP BY status)")
def a28(spark, d):
    m, r, c = fx.memories(spark, d), fx.relations(spark, d), fx.claims(spark, d)
    n = F.count(F.lit(1))
    one = lambda table, **named: table.agg(*(v.cast("long").alias(k) for k, v in named.items())).selectExpr(f"stack({len(named)}, {', '.join(f'''{chr(39)}{k}{chr(39)}, {k}''' for k in named)}) AS (metric, n)")
    by = lambda rows, name, key: rows.groupBy(F.concat(F.lit(f"{name}:"), key).alias("metric")).agg(n.alias("n"))
    return reports.stacked([
        one(m, rows=n, scopes=F.countDistinct("scope_id"), visible=F.count_if(policy.ordinary_visible()), invalid_metadata=F.count_if(F.expr("try_parse_json(metadata) IS NULL")), characters=F.sum(F.char_length("content").cast("long"))),
        by(m, "lifecycle", policy.lifecycle()), by(m, "target", F.col("target")), one(r, relations=n), by(r, "relation", F.col("relation_type")),
        one(c, claims=n, subjects=F.countDistinct("subject_key")), one(fx.vectors(spark, d), vectors=n), by(fx.outbox(spark, d), "outbox", F.col("status")),
    ])


@register("a34_governance_cycle", _LINT + _DECIDED + f", fg AS (SELECT CASE WHEN regexp_matches(content, '{q(text.SECRET)}') OR regexp_matches(content, '{q(reports.WRAPPER_NOISE)}') THEN 'hard' WHEN target = 'general' AND source = 'turn-assistant' OR length(trim(content)) <= 24 OR dedup_key <> '' AND row_number() OVER (PARTITION BY scope_id, target, dedup_key ORDER BY created_at, id) > 1 THEN 'soft' WHEN life = 'candidate' THEN 'review' END AS action FROM st) SELECT 'decision:' || action AS metric, count(*) AS n FROM de GROUP BY action UNION ALL SELECT 'forget:' || action, count(*) FROM fg WHERE action IS NOT NULL GROUP BY action UNION ALL SELECT 'lifecycle:' || life, count(*) FROM st GROUP BY life UNION ALL SELECT 'rule:' || rule, count(*) FROM br GROUP BY rule")
def a34(spark, d):
    m = judged(spark, d)
    n = F.count(F.lit(1)).alias("n")
    by = lambda rows, name, key: rows.groupBy(F.concat(F.lit(f"{name}:"), key).alias("metric")).agg(n)
    return reports.stacked([by(reports.quality_decisions(m), "decision", F.col("action")), by(reports.forgetting(m), "forget", F.col("action")), by(m, "lifecycle", policy.lifecycle()), by(reports.quality_rules(m), "rule", F.col("rule"))])


_STEPS = "SELECT 'start' AS step, 'gen-0' AS generation_id, 'active' AS status, '' AS previous UNION ALL SELECT * FROM (VALUES ('start', 'gen-1', 'ready', ''), ('start', 'gen-2', 'ready', ''), ('conflict', 'gen-0', 'active', ''), ('conflict', 'gen-1', 'ready', ''), ('conflict', 'gen-2', 'ready', ''), ('activated', 'gen-0', 'retired', ''), ('activated', 'gen-1', 'active', 'gen-0'), ('activated', 'gen-2', 'ready', ''), ('back', 'gen-0', 'active', ''), ('back', 'gen-1', 'ready', ''), ('back', 'gen-2', 'ready', ''))"


@register("m19_generations", fx.with_("outbox") + f", s AS ({_STEPS}), g AS (SELECT generation_id, count(*) AS events FROM outbox GROUP BY 1) SELECT step, generation_id, status, previous, events FROM s JOIN g USING (generation_id)")
def m19(spark, d):
    g = fx.outbox(spark, d).groupBy("generation_id").agg(F.count(F.lit(1)).alias("events"))
    start = g.select("generation_id", F.when(F.col("generation_id") == "gen-0", "active").otherwise("ready").alias("status"), F.lit(None).cast("string").alias("previous"))
    on = govern.activated(start, "gen-1", "gen-0")
    steps = {"start": start, "conflict": govern.activated(start, "gen-1", "gen-2"), "activated": on, "back": govern.rolled_back(on, "gen-1")}
    rows = reports.stacked([x.select(F.lit(k).alias("step"), "generation_id", "status", F.coalesce("previous", F.lit("")).alias("previous")) for k, x in steps.items()])
    return rows.join(g, "generation_id")
