"""Memory-shaped relations derived from the test tables, in Spark and, by the same rules, as SQL for the oracle.

No randomness and no clock: every value follows from the row. Times are naive; ages are taken against a given instant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import spread

AS_OF = "2024-02-15 00:00:00"

_LIFECYCLE = "CASE doc_id % 11 WHEN 0 THEN 'archived' WHEN 1 THEN 'Superseded' WHEN 2 THEN 'obsolete' WHEN 3 THEN 'rejected' WHEN 4 THEN 'candidate' WHEN 5 THEN 'scratch' WHEN 6 THEN 'in_progress' ELSE 'promoted' END"
_TYPE = "CASE doc_id % 7 WHEN 0 THEN 'factual' WHEN 1 THEN 'preference' WHEN 2 THEN 'decision' WHEN 3 THEN 'episodic' WHEN 4 THEN 'project' WHEN 5 THEN 'resource' ELSE '' END"

#: Columns that both engines evaluate as written.
MEMORY = {
    "id": "CAST(doc_id AS STRING)",
    "scope_id": "source",
    "target": "CASE doc_id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'memory' WHEN 2 THEN 'project' WHEN 3 THEN 'ops' ELSE 'general' END",
    "source": "CASE doc_id % 4 WHEN 0 THEN 'builtin-curated' WHEN 1 THEN 'tool_store' WHEN 2 THEN 'journal-digest' ELSE 'turn-assistant' END",
    "content": "text",
    "summary": "left(text, 220)",
    "created_at": "TIMESTAMP '2023-01-01 00:00:00' + (doc_id % 400) * INTERVAL '1' DAY",
    "updated_at": "TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE",
    "metadata": "CASE WHEN doc_id % 17 = 0 THEN '{broken' ELSE concat('{\"lifecycle\": \"', " + _LIFECYCLE + ", '\", \"memory_type\": \"', " + _TYPE + ", '\", \"confidence\": 0.', CAST(doc_id % 9 + 1 AS STRING), ', \"importance\": 0.', CAST(doc_id % 8 + 1 AS STRING), '}') END",
}
CLAIM = {
    "claim_id": "CAST(event_id AS STRING)",
    "memory_id": "CAST(event_id % 1000 AS STRING)",
    "scope_id": "concat('scope-', CAST(user_id % 7 AS STRING))",
    "subject_key": "concat('user:', CAST(user_id AS STRING))",
    "predicate_key": "event_type",
    "value": "CAST(event_id % 13 AS STRING)",
    "valid_from": "ts",
    "recorded_at": "ts + (event_id % 5) * INTERVAL '1' HOUR",
    "confidence": "0.5E0 + (event_id % 50) / 1E2",
    "assertion_kind": "CASE event_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'inferred' ELSE 'validated' END",
}
RELATION = {
    "source_memory_id": "CAST(l_partkey % 500 AS STRING)",
    "target_memory_id": "CAST(l_suppkey * 7 % 500 AS STRING)",
    "relation_type": "CASE l_orderkey % 8 WHEN 0 THEN 'same_topic' WHEN 1 THEN 'supersedes' WHEN 2 THEN 'depends_on' WHEN 3 THEN 'owned_by' WHEN 4 THEN 'affects' WHEN 5 THEN 'invalidates' WHEN 6 THEN 'supports' ELSE 'contradicts' END",
}
FRESHNESS = {
    "id": "CAST(doc_id AS STRING)",
    "status": "CASE doc_id % 6 WHEN 0 THEN 'current' WHEN 1 THEN 'verified' WHEN 2 THEN 'needs_live_check' WHEN 3 THEN 'stale' ELSE 'expired' END",
    "truth_type": "CASE WHEN doc_id % 10 = 3 THEN 'operational_status' ELSE 'memory_fact' END",
}
_A, _B = "CAST(doc_id * 7 % 23 AS STRING)", "CAST(doc_id * 11 % 23 AS STRING)"
#: Notes with facts, relations, denials, paths and secrets: each document's text and a sentence behind it.
NOTE = {
    "id": "CAST(doc_id AS STRING)",
    "n": "doc_id",
    "scope_id": "concat('tenant-', CAST(doc_id % 25 AS STRING))",
    "target": MEMORY["target"],
    "source": MEMORY["source"],
    "updated_at": MEMORY["updated_at"],
    "created_at": MEMORY["created_at"],
    "metadata": MEMORY["metadata"],
    "content": "concat(text, chr(10), CASE doc_id % 19 "
    f"WHEN 0 THEN concat('The gate svc-', {_A}, ' depends on svc-', {_B}, ' for sessions. See https://github.com/acme/core/issues/', {_A}, '.') "
    f"WHEN 1 THEN concat('svc-', {_A}, ' provides an api endpoint and stores sessions.') "
    f"WHEN 2 THEN concat('svc-', {_A}, ' is owned by team-', {_B}, '.') "
    f"WHEN 3 THEN concat('team-', {_A}, ' is responsible for on-call of the cluster.') "
    f"WHEN 4 THEN concat('svc-', {_A}, ' does not depend on svc-', {_B}, '!') "
    f"WHEN 5 THEN concat('Release of svc-', {_A}, ' affects svc-', {_B}, ' today. 12 tests passed') "
    f"WHEN 6 THEN concat('svc-', {_A}, ' latency and throughput metrics are green') "
    f"WHEN 7 THEN concat('New svc-', {_A}, ' config replaces svc-', {_B}, ' from now on.') "
    f"WHEN 8 THEN concat('svc-', {_A}, ' is the old legacy version of svc-', {_B}) "
    f"WHEN 9 THEN concat('The migration of svc-', {_A}, ' invalidates svc-', {_B}, ' policy.') "
    f"WHEN 10 THEN concat('The svc port is ', {_A}) "
    f"WHEN 11 THEN concat('The svc port is not ', {_B}) "
    f"WHEN 12 THEN concat('User prefers svc-', {_A}, ' over svc-', {_B}, '. Deploy command is make svc-', {_A}) "
    f"WHEN 13 THEN concat('project atlas-', {_A}, ' runs on Ubuntu; the server timezone is UTC+2, see https://example.org/docs/', {_B}) "
    f"WHEN 14 THEN concat('我的服务器运行在', CASE doc_id % 5 WHEN 0 THEN '北京朝阳' WHEN 1 THEN '上海浦东' WHEN 2 THEN '广州天河' WHEN 3 THEN '深圳南山' ELSE '成都武侯' END, ' svc-', {_A}) "
    f"WHEN 15 THEN concat('部署位置在上海的主机 svc-', {_A}, ' 需要缓存, 见 `北京机房` 和 `当前机房的`') "
    f"WHEN 16 THEN concat('api_key = k', {_A}, 'value and files in /home/user', {_B}, '/notes for project borealis') "
    f"WHEN 17 THEN concat('Alice currently works at svc-', {_A}, '; she does not live in Rome') "
    f"WHEN 18 THEN concat('Commit 0123abcd', {_A}, 'ef: step 1) fix the bug 2) deploy. pytest shows 7 passed, smoke ok') "
    "END)",
}


def _columns(rules: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in rules.items()]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(read(spark, sf_dir, "documents")).selectExpr(*_columns(MEMORY))
    return rows.withColumn("dedup_key", F.regexp_replace(F.lower(F.trim("content")), r"\s+", " "))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ").alias("query"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions with a scope each, some of them after what is new, one that asks for a time zone, and one in words of which texts hold other names."""
    q = queries(spark, sf_dir)
    n = F.col("query_id").cast("long")
    rows = q.select("query_id", F.when(n % 4 == 0, F.concat(F.lit("latest "), "query")).otherwise(F.col("query")).alias("query"), F.concat(F.lit("src"), (n % 20).cast("string")).alias("scope_id"))
    return rows.unionByName(spark.sql("SELECT * FROM VALUES ('zone', 'what timezone does the server use', 'src1'), ('names', 'which style suits the reader', 'src2') AS q(query_id, query, scope_id)"))


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("doc_id % 6 <> 4").selectExpr(*_columns(FRESHNESS))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").selectExpr(*_columns(NOTE)).withColumn("summary", F.left("content", F.lit(220)))
    return rows.withColumn("dedup_key", F.regexp_replace(F.lower(F.trim("content")), r"\s+", " "))


def every_50th(rows: DataFrame, id: str = "id") -> DataFrame:
    """The stated set of queries of a search over a table: its rows whose number is divisible by 50."""
    return rows.where(F.col(id).cast("long") % 50 == 0)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").selectExpr(*_columns(CLAIM), "event_id")
    return rows.selectExpr(
        "*",
        "lead(valid_from) OVER (PARTITION BY subject_key, predicate_key ORDER BY valid_from, event_id) AS valid_to",
    ).selectExpr(
        "*",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE valid_to END AS retired_at",
        "CASE WHEN valid_to IS NOT NULL THEN 'superseded' WHEN event_id % 9 = 0 THEN 'uncertain' ELSE 'current' END AS status",
    ).drop("event_id")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr(*_columns(RELATION), "l_orderkey")
    return rows.groupBy(*RELATION).agg((0.3 + (F.min("l_orderkey") % 60) / 100.0).alias("confidence"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).select("id", "scope_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("entity"))
    return rows.select(F.col("id").alias("memory_id"), "scope_id", "entity")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("scope_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("n"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.concat(F.lit("scope-"), (F.col("conv_id") % 5).cast("string")).alias("scope_id"),
        F.col("turn").cast("int").alias("turn_number"),
        "role",
        F.col("text").alias("content"),
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("run-"), (F.col("conv_id") % 4).cast("string"))).alias("processed_run_id"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "concat('k', CAST(user_id AS STRING), '-', event_type) AS event_key",
        "CAST(user_id AS STRING) AS memory_id",
        "CASE event_id % 5 WHEN 0 THEN 'delete' ELSE 'upsert' END AS operation",
        "CASE event_id % 7 WHEN 0 THEN 'dead' WHEN 1 THEN 'claimed' WHEN 2 THEN 'pending' ELSE 'completed' END AS status",
        "CAST(event_id % 6 AS INT) AS attempts",
        "concat('gen-', CAST(user_id % 3 AS STRING)) AS generation_id",
        "ts AS available_at",
        "ts AS updated_at",
    )


def _cte(name: str, rules: dict[str, str], table: str) -> str:
    return f"{name} AS (SELECT {', '.join(_columns(rules))} FROM {table})"


#: The same relations for the oracle; joined by commas behind WITH.
SQL = {
    "memories": _cte("memories0", MEMORY, "documents") + ", memories AS (SELECT *, regexp_replace(lower(trim(content)), '\\s+', ' ', 'g') AS dedup_key FROM memories0)",
    "queries": "queries AS (SELECT CAST(item_id AS VARCHAR) AS query_id, array_to_string(regexp_split_to_array(text, '\\s+')[1:8], ' ') AS query FROM benchmark)",
    "asked": "asked AS (SELECT query_id, CASE WHEN CAST(query_id AS BIGINT) % 4 = 0 THEN 'latest ' || query ELSE query END AS query, 'src' || CAST(CAST(query_id AS BIGINT) % 20 AS VARCHAR) AS scope_id FROM queries UNION ALL SELECT 'zone', 'what timezone does the server use', 'src1' UNION ALL SELECT 'names', 'which style suits the reader', 'src2')",
    "freshness": _cte("freshness", FRESHNESS, "documents WHERE doc_id % 6 <> 4"),
    "notes": _cte("notes0", NOTE, "documents") + ", notes AS (SELECT *, left(content, 220) AS summary, regexp_replace(lower(trim(content)), '\\s+', ' ', 'g') AS dedup_key FROM notes0)",
    "claims": f"claims0 AS (SELECT {', '.join(_columns(CLAIM))}, event_id FROM events), claims1 AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject_key, predicate_key ORDER BY valid_from, event_id) AS valid_to FROM claims0), claims AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE valid_to END AS retired_at, CASE WHEN valid_to IS NOT NULL THEN 'superseded' WHEN event_id % 9 = 0 THEN 'uncertain' ELSE 'current' END AS status FROM claims1)",
    "relations": f"relations0 AS (SELECT {', '.join(_columns(RELATION))}, l_orderkey FROM lineitem), relations AS (SELECT source_memory_id, target_memory_id, relation_type, 0.3e0 + (min(l_orderkey) % 60) / 1e2 AS confidence FROM relations0 GROUP BY 1, 2, 3)",
    "entities": "entities AS (SELECT DISTINCT id AS memory_id, scope_id, unnest(regexp_extract_all(lower(content), '[a-z]{4,}')) AS entity FROM memories)",
    "vectors": "vectors AS (SELECT CAST(vec_id AS VARCHAR) AS id, 'label-' || CAST(label AS VARCHAR) AS scope_id, embedding AS vector, vec_id AS n FROM embeddings)",
    "journal": "journal AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, 'scope-' || CAST(conv_id % 5 AS VARCHAR) AS scope_id, CAST(turn AS INTEGER) AS turn_number, role, text AS content, CASE WHEN conv_id % 3 = 0 THEN 'run-' || CAST(conv_id % 4 AS VARCHAR) END AS processed_run_id FROM conversations)",
    "outbox": "outbox AS (SELECT event_id AS id, 'k' || CAST(user_id AS VARCHAR) || '-' || event_type AS event_key, CAST(user_id AS VARCHAR) AS memory_id, CASE event_id % 5 WHEN 0 THEN 'delete' ELSE 'upsert' END AS operation, CASE event_id % 7 WHEN 0 THEN 'dead' WHEN 1 THEN 'claimed' WHEN 2 THEN 'pending' ELSE 'completed' END AS status, CAST(event_id % 6 AS INTEGER) AS attempts, 'gen-' || CAST(user_id % 3 AS VARCHAR) AS generation_id, ts AS available_at, ts AS updated_at FROM events)",
}


def with_(*names: str) -> str:
    """``WITH`` the named relations; what they need comes first."""
    needs = {"entities": ("memories",), "asked": ("queries",)}
    order = list(dict.fromkeys(x for n in names for x in (*needs.get(n, ()), n)))
    return "WITH " + ", ".join(SQL[n] for n in order) + " "
