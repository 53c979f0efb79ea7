"""Queries of text functions, candidates, fusion, ranking and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import policy, text
from ..operators import recall, scan
from . import fixtures as fx
from .registry import register
from .scans import LIFE

TOK = "regexp_extract_all(lower({}), '[a-zA-Z0-9]{{2,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')"


def tok(x: str) -> str:
    return TOK.format(x)


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


STEM = r"""CASE WHEN NOT regexp_full_match(t, '[a-zA-Z]+') THEN t
 WHEN length(t) > 4 AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y'
 WHEN length(t) > 4 AND t LIKE '%ing' THEN CASE WHEN length(t) >= 5 AND t[length(t)-3] = t[length(t)-4] THEN left(t, length(t) - 4) ELSE left(t, length(t) - 3) END
 WHEN length(t) > 3 AND t LIKE '%ed' THEN CASE WHEN length(t) >= 4 AND t[length(t)-2] = t[length(t)-3] THEN left(t, length(t) - 3) ELSE left(t, length(t) - 2) END
 WHEN length(t) > 4 AND t LIKE '%es' AND NOT (t LIKE '%ses' OR t LIKE '%xes' OR t LIKE '%zes' OR t LIKE '%ches' OR t LIKE '%shes') THEN left(t, length(t) - 1)
 WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END"""


@register("n1_tokens", f"SELECT doc_id, unnest(list_distinct({tok('text')})) AS token FROM documents")
def n1(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", F.explode(text.query_tokens("text")).alias("token"))


@register("n3_semantic_tokens", fx.with_("queries") + f"SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest({tok('query')}) AS token FROM queries) WHERE NOT list_contains({listed(text.SEMANTIC_STOPWORDS)}, token)")
def n3(spark, d):
    return fx.queries(spark, d).select("query_id", F.explode(text.semantic_tokens("query")).alias("token"))


@register("n4_stems", f"SELECT DISTINCT t AS token, {STEM} AS stem FROM (SELECT unnest({tok('text')}) AS t FROM documents)")
def n4(spark, d):
    return fx.read(spark, d, "documents").select(F.explode(text.query_tokens("text")).alias("token")).distinct().select("token", text.stem(F.col("token")).alias("stem"))


def norm(rows: str) -> str:
    return f"SELECT DISTINCT id, u FROM (SELECT id, unnest([t, {STEM}]) AS u FROM (SELECT id, unnest({tok('body')}) AS t FROM ({rows})))"


@register("n13_dedup_keys", fx.with_("memories") + "SELECT dedup_key, count(*) AS n FROM memories GROUP BY dedup_key HAVING count(*) > 1")
def n13(spark, d):
    return fx.read(spark, d, "documents").groupBy(text.dedup_key("text").alias("dedup_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@register("n16_visible_page_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script\s*>', ' ', 'gis'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g')) AS visible FROM pages")
def n16(spark, d):
    return fx.read(spark, d, "pages").select("page_id", text.strip_html("html").alias("visible"))


@register("n23_decay", fx.with_("memories") + "SELECT id, round(greatest(0.65e0, 0.7e0 * pow(0.5e0, u / 180) + 0.3e0 * pow(0.5e0, c / 360)), 6) AS decay FROM (SELECT id, (epoch(TIMESTAMP '2024-02-15 00:00:00') - epoch(updated_at)) / 86400e0 AS u, (epoch(TIMESTAMP '2024-02-15 00:00:00') - epoch(created_at)) / 86400e0 AS c FROM memories)")
def n23(spark, d):
    days = lambda c: (F.lit(fx.AS_OF).cast("timestamp").cast("long") - F.col(c).cast("timestamp").cast("long")) / 86400.0
    return fx.memories(spark, d).select("id", F.round(policy.decay(days("updated_at"), days("created_at")), 6).alias("decay"))


_FRESH = "CASE CAST(id AS BIGINT) % 6 WHEN 0 THEN 'current' WHEN 1 THEN ' Verified' WHEN 2 THEN 'needs-live-check' WHEN 3 THEN 'stale' WHEN 4 THEN 'odd' END"


@register(
    "n26_freshness",
    fx.with_("memories") + f", f AS (SELECT id, {_FRESH} AS raw, updated_at + INTERVAL '20' DAY AS until FROM memories), g AS (SELECT id, raw, until, CASE WHEN raw IS NULL THEN 'unknown' ELSE replace(replace(lower(trim(raw)), ' ', '_'), '-', '_') END AS s FROM f), h AS (SELECT id, CASE WHEN s = 'odd' THEN 'unknown' WHEN s IN ('current', 'verified') AND until < TIMESTAMP '2024-01-21 08:00:00' THEN 'expired' ELSE s END AS status FROM g) SELECT id, status, CASE status WHEN 'current' THEN 0 WHEN 'verified' THEN 0 WHEN 'unknown' THEN 1 WHEN 'stale' THEN 3 ELSE 2 END AS severity, CASE WHEN status IN ('needs_live_check', 'unknown') THEN 0.18e0 WHEN status = 'expired' THEN 0.45e0 WHEN status = 'stale' THEN 0.35e0 ELSE 0e0 END AS penalty FROM h",
)
def n26(spark, d):
    m = fx.memories(spark, d).selectExpr("id", f"{_FRESH} AS raw", "updated_at + INTERVAL '20' DAY AS until")
    m = m.select("id", policy.freshness_status(F.col("raw"), F.col("until"), F.lit("2024-01-21 08:00:00").cast("timestamp")).alias("status"))
    return m.select("id", "status", policy.severity(F.col("status")).alias("severity"), policy.freshness_penalty(F.col("status")).alias("penalty"))


@register("n31_redacted_secrets", "SELECT doc_id, sha256(regexp_replace(text, '(?i)\\b(api[_-]?key|token|secret|password|passwd|private[_-]?key)\\s*[:=]\\s*[^\\s]+', '\\1=[REDACTED]', 'g')) AS redacted FROM documents")
def n31(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", F.sha2(text.redact_secrets("text"), 256).alias("redacted"))


@register("n36_sentences", "SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(max(length(s)) AS BIGINT) AS longest FROM (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.!?。！？；;\\n]+')), ' ') AS s FROM documents) WHERE s <> '' GROUP BY doc_id")
def n36(spark, d):
    s = fx.read(spark, d, "documents").select("doc_id", F.explode(text.split_sentences("text")).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("s")).cast("long").alias("longest"))


@register("n44_coverage", "SELECT doc_id, round((CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'haea') AS INT) + CAST(contains(lower(text), 'zzz') AS INT)) / 3e0, 6) AS coverage FROM documents")
def n44(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", F.round(text.coverage(F.col("text"), F.array(*map(F.lit, ["tion", "haea", "ZZZ"]))), 6).alias("coverage"))


@register("n46_json_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events")
def n46(spark, d):
    return fx.read(spark, d, "events").select("event_id", policy.json_text("props", "$.k").cast("long").alias("k"), F.expr("try_parse_json(props) IS NOT NULL").alias("valid"))


@register(
    "a10_rank_fusion",
    "WITH r AS (SELECT CAST(user_id AS VARCHAR) AS query_id, CAST(event_id % 37 AS VARCHAR) AS id, CASE event_id % 4 WHEN 0 THEN 'lexical' WHEN 1 THEN 'vector' WHEN 2 THEN 'bm25' ELSE 'curated' END AS signal, value, event_id FROM events), k AS (SELECT query_id, id, signal, row_number() OVER (PARTITION BY query_id, signal ORDER BY value DESC, id) AS rank FROM (SELECT query_id, id, signal, max(value) AS value FROM r GROUP BY 1, 2, 3)), "
    "s AS (SELECT query_id, id, sum(CASE WHEN signal = 'curated' THEN 1.25e0 ELSE 1e0 END / (60 + rank)) AS raw, count(DISTINCT signal) AS signals FROM k GROUP BY 1, 2) SELECT query_id, id, signals, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS rrf FROM s WHERE signals >= 2",
)
def a10(spark, d):
    e = fx.read(spark, d, "events").selectExpr("CAST(user_id AS STRING) AS query_id", "CAST(event_id % 37 AS STRING) AS id", "CASE event_id % 4 WHEN 0 THEN 'lexical' WHEN 1 THEN 'vector' WHEN 2 THEN 'bm25' ELSE 'curated' END AS signal", "value")
    e = e.groupBy("query_id", "id", "signal").agg(F.max("value").alias("value"))
    ranked = e.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "signal").orderBy(F.desc("value"), "id")))
    return recall.fuse(ranked).select("query_id", "id", "signals", F.round("rrf", 6).alias("rrf"))


@register("o6_priority_order", fx.with_("memories") + "SELECT id FROM memories WHERE scope_id = 'src4' ORDER BY CASE source WHEN 'builtin-curated' THEN 0 WHEN 'tool_store' THEN 1 ELSE 2 END, CASE target WHEN 'user' THEN 0 WHEN 'memory' THEN 1 ELSE 2 END, updated_at DESC, id LIMIT 15")
def o6(spark, d):
    m = fx.memories(spark, d).where("scope_id = 'src4'")
    return m.orderBy(policy.mapped(F.col("source"), {"builtin-curated": 0, "tool_store": 1}, 2), policy.mapped(F.col("target"), {"user": 0, "memory": 1}, 2), F.desc("updated_at"), "id").limit(15).select("id")


@register("q9_profile", fx.with_("memories") + f"SELECT id, target, rank FROM (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY CASE source WHEN 'builtin-curated' THEN 0 ELSE 1 END, updated_at DESC, id) AS rank FROM memories WHERE {LIFE} IN ('', 'promoted') AND target <> 'general') WHERE rank <= 6")
def q9(spark, d):
    m = scan.scoped(fx.memories(spark, d).where("target <> 'general'"), [f"src{i}" for i in range(20)], policy.profile_visible())
    return recall.top(m, "target", 6, policy.mapped(F.col("source"), {"builtin-curated": 0}, 1), F.desc("updated_at"), F.col("id")).select("id", "target", "rank")
