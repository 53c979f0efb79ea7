"""Queries over short notes and whole texts: CJK search, conflicts, intents, entities, redaction, facts, digests, evidence, relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities as ent
from ..functions import evidence, intent, policy, relations, text
from ..operators import classes, govern, graph, recall, relate
from ..sources.scratch import written
from . import fixtures as fx
from .hybrid import canon, entity_cte, raw_entities
from .recalling import STEM, listed, tok
from .registry import register
from .scans import HIDDEN, LIFE

RUN = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]+"
_RUNS = f"(SELECT id, unnest(regexp_extract_all(content, '{RUN}')) AS r FROM notes)"
#: id, gram and its place: trigrams first, then bigrams, each by its first occurrence.
_GRAMS = (
    f", runs AS (SELECT id, r, row_number() OVER () AS k FROM {_RUNS}), g0 AS (SELECT id, n, k, i, substr(r, i, n) AS g FROM (SELECT *, unnest(generate_series(1, length(r) - n + 1)) AS i FROM runs, (SELECT unnest([3, 2]) AS n)) WHERE length(r) >= n), "
    "g1 AS (SELECT id, g, length(g) AS n, row_number() OVER (PARTITION BY id ORDER BY -length(g), min(k), min(i)) AS p FROM g0 GROUP BY id, g), grams AS (SELECT * FROM g1 WHERE p <= 24) "
)


def q(text_: str) -> str:
    return text_.replace("'", "''")


def every_7th(rows):
    """The questions of p12, n12 and j2: notes whose number is divisible by 7."""
    return rows.where(F.col("id").cast("long") % 7 == 0)


@register("n10_cjk_ngrams", fx.with_("notes") + _GRAMS + "SELECT id, count(*) AS n, string_agg(g, ',' ORDER BY g) AS grams FROM grams GROUP BY id")
def n10(spark, d):
    rows = fx.notes(spark, d).select("id", text.cjk_ngrams("content").alias("g")).where(F.size("g") > 0)
    return rows.select("id", F.size("g").cast("long").alias("n"), F.array_join(F.sort_array("g"), ",").alias("grams"))


_STOPS = "|".join(sorted(text.CJK_STOPWORDS, key=len, reverse=True))


#: seg: id, token and term of every long CJK run of the notes.
_SEGMENTS = (
    f", cj_t AS (SELECT DISTINCT id, token FROM (SELECT id, unnest(regexp_extract_all(content, '[\\x{{4e00}}-\\x{{9fff}}]{{4,}}')) AS token FROM notes)), cj_p AS (SELECT DISTINCT id, token, piece FROM (SELECT *, unnest(regexp_split_to_array(regexp_replace(token, '{_STOPS}', ' ', 'g'), ' +')) AS piece FROM cj_t) WHERE length(piece) >= 2), "
    f"cj_s AS (SELECT DISTINCT id, token, term FROM (SELECT id, token, piece AS term FROM cj_p UNION ALL SELECT id, token, substr(piece, i, n) FROM (SELECT *, unnest(generate_series(1, length(piece) - n + 1)) AS i FROM cj_p, (SELECT unnest([2, 3]) AS n) WHERE length(piece) > n)) WHERE term <> token AND NOT list_contains({listed(text.CJK_STOPWORDS)}, term)), "
    "cj_k AS (SELECT * FROM cj_s a WHERE length(term) > 2 OR NOT EXISTS (SELECT 1 FROM cj_s b WHERE b.id = a.id AND b.token = a.token AND length(b.term) > length(a.term) AND contains(b.term, a.term))), "
    "seg AS (SELECT id, token, term FROM (SELECT *, row_number() OVER (PARTITION BY id, token ORDER BY -length(term), strpos(token, term), term) AS r FROM cj_k) WHERE r <= 11) "
)


@register("n2_cjk_segments", fx.with_("notes") + _SEGMENTS + "SELECT * FROM seg")
def n2(spark, d):
    runs = F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\x{4e00}-\x{9fff}]{4,}"), F.lit(0)))
    return fx.notes(spark, d).select("id", F.explode(runs).alias("token")).select("id", "token", F.explode(text.cjk_segments(F.col("token"))).alias("term"))


@register("n12_cjk_substring_score", fx.with_("notes") + _GRAMS + ", hit AS (SELECT a.id AS query_id, b.id, count(CASE WHEN a.n = 3 THEN 1 END) AS t, count(CASE WHEN a.n = 2 THEN 1 END) AS u FROM grams a JOIN notes b ON contains(b.content, a.g) WHERE CAST(a.id AS BIGINT) % 7 = 0 GROUP BY 1, 2) SELECT query_id, id, round(least(0.5e0, 0.12e0 + 0.04e0 * least(t + u, 6)), 6) AS score FROM hit WHERE t >= 1 OR u >= 2")
def n12(spark, d):
    n = fx.notes(spark, d).select("id", "content")
    asked = every_7th(n).select(F.col("id").alias("query_id"), text.cjk_ngrams("content").alias("keys"))
    held = n.where(F.col("content").rlike(text.CJK_RUN)).select("id", text.all_cjk_ngrams("content").alias("keys"))
    hits = lambda k: F.count_if(F.char_length("key") == k).alias(f"n{k}")
    pairs = classes.sharing(asked, held, hits(3), hits(2))
    return pairs.select("query_id", "id", F.round(text.cjk_score(F.col("n3"), F.col("n2")), 6).alias("score")).where("score > 0")


@register("n11_trigram_terms", fx.with_("notes") + _GRAMS + f", w AS (SELECT id, t, min(i) AS i FROM (SELECT id, unnest(x) AS t, unnest(generate_series(1, len(x))) AS i FROM (SELECT id, {tok('content')} AS x FROM notes WHERE NOT regexp_matches(content, '[\\x{{4e00}}-\\x{{9fff}}]'))) WHERE length(t) >= 3 GROUP BY 1, 2) SELECT id, string_agg(t, ',' ORDER BY i) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM w) WHERE r <= 24 GROUP BY id")
def n11(spark, d):
    rows = fx.notes(spark, d).where(~F.col("content").rlike(r"[\x{4e00}-\x{9fff}]")).select("id", text.trigram_terms("content").alias("t")).where(F.size("t") > 0)
    return rows.select("id", F.array_join("t", ",").alias("terms"))


@register("j2_ngram_postings", fx.with_("notes") + _GRAMS + ", b AS (SELECT id, g FROM grams WHERE n = 2), df AS (SELECT g, count(*) AS df FROM b GROUP BY g HAVING count(*) <= greatest(50, 0.05e0 * (SELECT count(*) FROM notes))) SELECT a.id AS query_id, b.id, count(*) AS hits FROM b a JOIN df USING (g) JOIN b USING (g) WHERE CAST(a.id AS BIGINT) % 7 = 0 GROUP BY 1, 2")
def j2(spark, d):
    n = fx.notes(spark, d)
    postings = written(n.select("id", F.explode(F.filter(text.cjk_ngrams("content"), lambda t: F.char_length(t) == 2)).alias("term")))
    rare = recall.rare_terms(postings, n.count())
    held = postings.join(rare, "term", "left_semi").groupBy("id").agg(F.collect_list("term").alias("keys"))
    return classes.sharing(every_7th(held).withColumnRenamed("id", "query_id"), held, F.count(F.lit(1)).alias("hits"))


_NEG = q(govern.NEGATION)
_CLAIM = q(govern.CLAIM)
_VERB = f"trim(regexp_replace(lower(regexp_extract(content, '{_CLAIM}', 2)), '{_NEG}', ' ', 'g'))"
_CONFLICTS = (
    f", r AS (SELECT scope_id, dedup_key, min(id) AS id, min_by(content, id) AS content FROM notes GROUP BY 1, 2), c AS (SELECT *, regexp_matches(content, '{_NEG}') AS denies, list_distinct(list_filter(regexp_extract_all(lower(CASE WHEN {_VERB} IN ('is', 'are', 'was', 'were') THEN regexp_extract(content, '{_CLAIM}', 1) ELSE regexp_extract(content, '{_CLAIM}', 1) || ' ' || {_VERB} END), '[\\w-]+'), lambda w: NOT list_contains({listed(govern.CLAIM_STOPWORDS)}, w))) AS slot, "
    f"list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(regexp_extract(content, '{_CLAIM}', 3), '{_NEG}', ' ', 'g')), '[\\w-]+'), lambda w: NOT list_contains({listed(govern.CLAIM_STOPWORDS)}, w))) AS value FROM r WHERE regexp_matches(content, '{_CLAIM}')), "
    f"u AS (SELECT id, list(DISTINCT {canon('u')}) AS known FROM (SELECT id, unnest([t, {STEM}]) AS u FROM (SELECT id, unnest({tok('content')}) AS t FROM r)) GROUP BY id) "
    "SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM c x JOIN c y ON x.scope_id = y.scope_id AND NOT x.denies AND y.denies JOIN u ux ON ux.id = x.id JOIN u uy ON uy.id = y.id WHERE len(x.slot) > 0 AND len(y.slot) > 0 AND len(x.value) > 0 AND len(y.value) > 0 AND len(list_intersect(x.slot, y.slot)) / CAST(least(len(x.slot), len(y.slot)) AS DOUBLE) >= 0.75 AND len(list_intersect(x.value, y.value)) / CAST(least(len(x.value), len(y.value)) AS DOUBLE) >= 0.6 "
    "AND greatest(len(list_intersect(ux.known, uy.known)) / CAST(len(ux.known) + len(uy.known) - len(list_intersect(ux.known, uy.known)) AS DOUBLE), 0.82e0 * len(list_intersect(ux.known, uy.known)) / least(len(ux.known), len(uy.known))) >= 0.35"
)
#: The last line of each note: one assertion.
_SHORT = fx.with_("notes").replace(", notes AS (", ", all_notes AS (") + ", last AS (SELECT * REPLACE (split_part(content, chr(10), -1) AS content) FROM all_notes), notes AS (SELECT * REPLACE (regexp_replace(lower(trim(content)), '\\s+', ' ', 'g') AS dedup_key) FROM last)"


@register("n14_conflicts", _SHORT + _CONFLICTS)
def n14(spark, d):
    last = fx.notes(spark, d).withColumn("content", F.substring_index("content", "\n", -1))
    return govern.conflicts(last.withColumn("dedup_key", text.dedup_key("content")))


@register("p12_scope_mismatch", fx.with_("notes") + r", p AS (SELECT id, list_transform(regexp_extract_all(content, '(?i)\bproject[\s:_-]+([a-z0-9][a-z0-9-]{1,40})', 1), lambda p: lower(p)) AS ps FROM notes) SELECT a.id AS query_id, count(*) AS n, min(b.id) AS first FROM p a, p b WHERE CAST(a.id AS BIGINT) % 7 = 0 AND len(a.ps) > 0 AND len(b.ps) > 0 AND len(list_intersect(a.ps, b.ps)) = 0 GROUP BY 1")
def p12(spark, d):
    n = fx.notes(spark, d).select("id", relations.projects(F.col("content")).alias("keys")).where(F.size("keys") > 0)
    n = written(n)
    return classes.apart(every_7th(n).withColumnRenamed("id", "query_id"), n)


_QUESTIONS = "VALUES ('place', '我的服务器在哪里'), ('system', '主机运行什么操作系统'), ('zone', 'what timezone does the server use now'), ('none', 'how do I deploy')"
_CUR, _OSA, _TZA = q(text.CURRENT_STATE), q(intent.SYSTEM_ANSWER.replace("(?is)", "(?s)")), q(intent.TIMEZONE_ANSWER.replace("(?is)", "(?s)"))


@register("n17_matched_intent", fx.with_("notes") + f", d AS (SELECT id, lower(content) AS d FROM notes) SELECT 'place' AS query_id, id, len(list_filter({listed(intent.LOCATION_EVIDENCE)}, lambda t: contains(d, t))) AS n FROM d WHERE len(list_filter({listed(intent.LOCATION_EVIDENCE)}, lambda t: contains(d, t))) > 0 "
    f"UNION ALL SELECT 'system', id, len(list_filter({listed(intent.SYSTEM_EVIDENCE)}, lambda t: contains(d, t))) FROM d WHERE (regexp_matches(d, '{_CUR}') OR regexp_matches(d, '{_OSA}')) AND len(list_filter({listed(intent.SYSTEM_EVIDENCE)}, lambda t: contains(d, t))) > 0 "
    f"UNION ALL SELECT 'zone', id, len(list_distinct(list_concat(list_filter({listed(intent.TIMEZONE_TERMS)}, lambda t: contains(d, t)), [regexp_extract(d, '{q(intent._ZONE)}')]))) FROM d WHERE contains(d, 'server') AND regexp_matches(d, '{_TZA}')")
def n17(spark, d):
    asked = spark.sql(f"SELECT * FROM {_QUESTIONS} AS t(query_id, query)")
    pairs = recall.against(fx.notes(spark, d).select("id", "content"), asked)
    return pairs.select("query_id", "id", F.size(intent.matched_terms("query", "content")).alias("n")).where("n > 0")


@register("n17_asks_current_state", f"SELECT doc_id, regexp_matches(lower(text), '{_CUR}|\\btime\\s*zone\\b|\\btimezone\\b|时区') AND NOT regexp_matches(lower(text), '{q(text.HISTORICAL_STATE)}') AS current_state FROM documents")
def n17c(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", intent.asks_current_state("text").alias("current_state"))


@register("n18_entities", "WITH d AS (SELECT doc_id AS id, text FROM documents)" + entity_cte("x", "id", raw_entities("text"), "d") + "SELECT id AS doc_id, unnest(es) AS entity FROM x")
def n18(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", F.explode(ent.entities_of("text")).alias("entity"))


@register("n19_entity_bonus", fx.with_("notes") + entity_cte("x", "id", raw_entities("content"), "notes") + ", e AS (SELECT id, unnest(es) AS e FROM x), s AS (SELECT id, len(es) AS n FROM x) SELECT a.id AS query_id, b.id, round(0.06e0 * count(*) / any_value(n), 6) AS bonus FROM e a JOIN e b USING (e) JOIN s ON s.id = a.id WHERE CAST(a.id AS BIGINT) % 50 = 0 GROUP BY 1, 2")
def n19(spark, d):
    own = fx.notes(spark, d).select("id", ent.entities_of("content").alias("own")).where(F.size("own") > 0)
    asked = fx.every_50th(own).select(F.col("id").alias("query_id"), F.col("own").alias("asked"))
    pairs = recall.against(own, asked, F.arrays_overlap("own", "asked"))
    return pairs.select("query_id", "id", F.round(recall.ent_bonus(F.col("asked"), F.col("own")), 6).alias("bonus"))


_SECRET = "(?i)\\b(api[_-]?key|token|secret|password|passwd|private[_-]?key)\\s*[:=]\\s*[^\\s]+"


@register("n31_sanitized", fx.with_("notes") + f", r AS (SELECT id, content, regexp_replace(regexp_replace(content, '{q(text.DATA_URL)}', ' ', 'g'), '{q(text.ATTACHMENT)}', '', 'g') AS bare FROM notes) SELECT id, sha256(trim(regexp_replace(regexp_replace(bare, '{_SECRET}', '\\1=[REDACTED]', 'g'), '{q(text.PRIVATE_PATH)}', '\\1[REDACTED_PATH]', 'g'))) AS sanitized FROM r")
def n31s(spark, d):
    return fx.notes(spark, d).select("id", F.sha2(text.sanitized("content"), 256).alias("sanitized"))


@register("n32_sanitized_json")
def n32(spark, d):
    n = fx.notes(spark, d)
    nested = F.to_json(F.struct(F.col("id"), F.array("content").alias("lines"), F.struct(F.col("content").alias("api_key"), F.col("content").alias("text")).alias("inner")))
    return n.select("id", text.sanitize_json(nested).alias("clean"))


_SENT = "regexp_split_to_array(regexp_replace(trim(content), '([.!?。！？])\\s+', '\\1' || chr(10), 'g'), '[\\n;；]+')"
_FLAT = "regexp_replace(trim({}), '\\s+', ' ', 'g')"


def _cut(x: str) -> str:
    flat = _FLAT.format(x)
    return f"CASE WHEN length({flat}) <= 360 THEN {flat} ELSE rtrim(left({flat}, 359)) || '…' END"


@register("n36_stated_facts", fx.with_("notes") + f", s AS (SELECT id, rtrim(trim(unnest({_SENT})), '.!?。！？') AS s FROM notes), f AS (SELECT id, CASE WHEN regexp_matches(s, '{q(text.PREFERENCE)}') THEN 'preference' WHEN regexp_matches(s, '{q(text.DEPLOY)}') THEN 'procedure' WHEN regexp_matches(s, '{q(text.IDENTITY)}') AND len(regexp_split_to_array(trim(s), '\\s+')) <= 18 THEN 'fact' END AS category, s FROM s WHERE s <> '') "
    f"SELECT id, category, CASE category WHEN 'preference' THEN " + _cut(f"trim(regexp_extract(s, '{q(text.PREFERENCE)}', 1)) || ' prefers ' || trim(regexp_extract(s, '{q(text.PREFERENCE)}', 2)) || '.'") + " WHEN 'procedure' THEN " + _cut(f"'Production deploy command is ' || trim(regexp_extract(s, '{q(text.DEPLOY)}', 1)) || '.'") + " ELSE " + _cut("s || '.'") + " END AS content FROM f WHERE category IS NOT NULL")
def n36(spark, d):
    rows = fx.notes(spark, d).select("id", F.explode(text.stated_facts("content")).alias("f"))
    return rows.select("id", "f.category", "f.content")


_KIND = "CASE n % 6 WHEN 0 THEN 'workflow' WHEN 1 THEN 'summary' WHEN 2 THEN 'constraint' ELSE 'factual' END"
_CONF = "(n % 10) / 10e0"
_V = {k: q(getattr(evidence, k)) for k in ("RAW_TRACE", "TRANSIENT", "TOOLCHAIN", "VERIFIED", "TRIGGER", "STEPS", "CURRENT", "VOLATILE", "NORMATIVE", "NORMATIVE_GATE")}
_IS = lambda k: f"regexp_matches(content, '{_V[k]}')"


@register("n37_digest_rules", fx.with_("notes") + f", k AS (SELECT id, content, {_KIND} AS kind, {_CONF} AS conf, {_IS('VERIFIED')} AS verified, ({_IS('TRIGGER')} AND ({_IS('VERIFIED')} OR {_IS('STEPS')}) AND NOT {_IS('TRANSIENT')} AND NOT {_IS('RAW_TRACE')}) AS reusable FROM notes), "
    f"t AS (SELECT id, bool_or(regexp_matches(s, '{_V['CURRENT']}') AND regexp_matches(s, '{_V['VOLATILE']}') AND NOT regexp_matches(s, '{_V['NORMATIVE']}')) AS snap FROM (SELECT id, unnest(regexp_split_to_array(content, '[。！？!?;；\\n]+')) AS s FROM notes) GROUP BY id), "
    "p AS (SELECT id, string_agg(name, ',' ORDER BY name) AS pollution FROM (" + " UNION ALL ".join(f"SELECT id, '{name}' AS name FROM k WHERE regexp_matches(content, '{q(pattern)}')" + (f" AND NOT (kind IN ('workflow', 'constraint') AND {_IS('NORMATIVE_GATE')})" if name == "test_run_snapshot" else "") for name, pattern in evidence.POLLUTION.items()) + ") GROUP BY id) "
    f"SELECT k.id, CASE WHEN {_IS('RAW_TRACE')} OR {_IS('TRANSIENT')} OR {_IS('TOOLCHAIN')} AND NOT verified THEN 'reject' WHEN kind = 'workflow' AND reusable THEN 'promote' WHEN kind = 'summary' OR conf < 0.55 THEN 'candidate' WHEN reusable OR verified THEN 'promote' ELSE 'candidate' END AS action, coalesce(pollution, '') AS pollution, CASE WHEN kind = 'workflow' THEN 'experience_review' ELSE 'memory_review' END AS route, CASE WHEN snap THEN 'needs_live_check' ELSE 'promoted' END AS status FROM k JOIN t USING (id) LEFT JOIN p USING (id)")
def n37(spark, d):
    n = fx.notes(spark, d).selectExpr("id", "content", f"{_KIND} AS kind", "(n % 10) / 10E0 AS conf")
    a = evidence.admission("content", F.col("kind"), F.lit("promoted"))
    return n.select("id", evidence.digest_action("content", F.col("kind"), F.col("conf")).alias("action"), F.array_join(F.sort_array(evidence.pollution("content", F.col("kind"))), ",").alias("pollution"), a["route"].alias("route"), a["status"].alias("status"))


_BATCH = (
    "SELECT id AS candidate_id, concat('s', CAST(n % 97 AS {s})) AS session_id, CASE n % 6 WHEN 0 THEN 'workflow' WHEN 1 THEN 'summary' WHEN 2 THEN 'constraint' ELSE 'factual' END AS memory_type, content, scope_id, concat('u', CAST(n % 31 AS {s})) AS subject_key, 'state' AS predicate_key, CASE WHEN n % 2 = 0 THEN 'single' ELSE 'multi' END AS cardinality, "
    "CASE n % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'supersede' ELSE 'enrich' END AS action, CAST(n % 4 AS {s}) AS value FROM {t}"
)
_SOURCES = "SELECT concat('s', CAST(n % 97 AS {s})) AS session_id, CASE WHEN n % 97 % 3 = 0 THEN substr(content, 1, 4000) WHEN n % 97 % 3 = 1 THEN 'the run failed, an error came up' ELSE 'all fixed, though one error came up' END AS content FROM {t} WHERE n % 2 = 0"
_FLAT = "lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))"


@register("m18_quarantine", fx.with_("notes") + f", c AS ({_BATCH.format(s='VARCHAR', t='notes')}), s AS ({_SOURCES.format(s='VARCHAR', t='notes')}), "
    "r AS (" + " UNION ALL ".join(f"SELECT candidate_id, '{name}' AS reason FROM c WHERE regexp_matches(content, '{q(pattern)}')" + (f" AND NOT (memory_type IN ('workflow', 'constraint') AND {_IS('NORMATIVE_GATE')})" if name == "test_run_snapshot" else "") for name, pattern in evidence.POLLUTION.items())
    + f" UNION ALL SELECT candidate_id, 'outcome_contradicts_source' FROM c WHERE regexp_matches(content, '{q(evidence.SUCCESS)}') AND NOT regexp_matches(content, '{q(evidence.FAILURE)}') AND session_id IN (SELECT session_id FROM s GROUP BY 1 HAVING bool_or(regexp_matches(content, '{q(evidence.FAILURE)}')) AND NOT bool_or(regexp_matches(content, '{q(evidence.SUCCESS)}'))) "
    "UNION ALL SELECT candidate_id, 'same_batch_single_value_conflict' FROM (SELECT *, min(value) OVER w <> max(value) OVER w AS clash FROM c WHERE cardinality = 'single' AND action IN ('add', 'supersede') AND memory_type IN ('factual', 'constraint') WINDOW w AS (PARTITION BY scope_id, subject_key, predicate_key)) WHERE clash "
    f"UNION ALL SELECT candidate_id, 'source_transcript_copy' FROM (SELECT candidate_id, raw, len(list_filter(g, lambda x: list_contains(h, x))) / CAST(len(g) AS DOUBLE) AS overlap FROM (SELECT candidate_id, session_id, raw, list_transform(CASE WHEN (length(t) - 8) % 8 <> 0 THEN list_append(generate_series(1, length(t) - 7, 8), length(t) - 7) ELSE generate_series(1, length(t) - 7, 8) END, lambda i: substr(t, i, 8)) AS g FROM (SELECT candidate_id, session_id, length(content) AS raw, {_FLAT} AS t FROM c) WHERE length(t) >= 600) k "
    f"LEFT JOIN (SELECT session_id, list_distinct(flatten(list(list_transform(generate_series(1, greatest(length(t) - 7, 1)), lambda i: substr(t, i, 8))))) AS h FROM (SELECT session_id, {_FLAT} AS t FROM s) GROUP BY 1) USING (session_id)) WHERE raw > 16000 OR overlap >= 0.75) "
    "SELECT candidate_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY 1")
def m18q(spark, d):
    from ..operators import digest

    fx.notes(spark, d).createOrReplaceTempView("quarantine_notes")
    batch, sources = (spark.sql(x.format(s="STRING", t="quarantine_notes")) for x in (_BATCH, _SOURCES))
    return digest.quarantine(batch, sources).select("candidate_id", F.array_join("reasons", ",").alias("reasons"))


@register("n39_supported_claims", fx.with_("notes") + f", v AS (SELECT id, n, content, 'svc-' || {fx._A.replace('STRING', 'VARCHAR').replace('doc_id', 'n')} AS value FROM notes) SELECT id, contains(lower(content), 'alice currently works at ' || value) AS supported, contains(lower(content), '; she does not live in rome') AS retracted FROM v")
def n39(spark, d):
    n = fx.notes(spark, d).withColumn("value", F.expr(f"concat('svc-', {fx._A.replace('doc_id', 'n')})"))
    said = lambda f, s, p, v: f(F.col("content"), F.lit("user_message"), F.lit(s), F.lit(p), v)
    return n.select("id", said(evidence.supports, "Alice", "works at", F.col("value")).alias("supported"), said(evidence.retracts, "she", "live in", F.lit("Rome")).alias("retracted"))


@register("n41_artifacts", fx.with_("notes") + r", u AS (SELECT DISTINCT id, rtrim(u, '.,;:!?') AS url FROM (SELECT id, unnest(regexp_extract_all(content, 'https?://[^\s<>''\])}，。；、]+')) AS u FROM notes)) SELECT id, url, CASE WHEN contains(url, 'github.com/') THEN CASE WHEN contains(url, '/issues/') THEN 'github_issue' WHEN contains(url, '/pull/') THEN 'github_pull' ELSE 'github_repo' END ELSE 'url' END AS kind, CASE WHEN contains(url, 'github.com/') THEN split_part(url, '/', 4) || '/' || split_part(url, '/', 5) ELSE '' END AS repo FROM u")
def n41a(spark, d):
    rows = fx.notes(spark, d).select("id", F.explode(text.artifacts("content")).alias("a"))
    return rows.select("id", "a.url", "a.kind", "a.repo")


# Relations: the same rules once more for the oracle, from clauses to edges.
_VISIBLE_NOTES = f"(SELECT * FROM notes WHERE {LIFE} NOT IN {HIDDEN})"


def _clean(raw: str) -> str:
    """SQL: raw matches as entities, in a list."""
    marks = ent.MARKS.replace("'", "''")
    normal = f"list_transform({raw}, lambda e: left(lower(regexp_replace(trim(trim(e), '{marks}'), '\\s+', ' ', 'g')), 96))"
    return f"list_filter({normal}, lambda e: length(e) >= 2 AND NOT list_contains({listed(ent.COMMON)}, e) AND NOT contains(e, '_') AND NOT regexp_matches(e, '^[^a-z]*(?:(?:{'|'.join(ent.GENERIC)})(?:[^a-z]+|$))+$'))"


_E = raw_entities
_DISTINCTIVE = f"length(e) >= 3 AND NOT list_contains({listed(ent.GENERIC_RELATION)}, e) AND NOT regexp_matches(e, '^[0-9]+$')"


def _mention_sql() -> str:
    parts = []
    for kind, trigger in relate.TRIGGERS.items():
        said = f"NOT regexp_matches(c, '{q(relate.DENIALS[kind])}')"
        after = f"left(regexp_extract(c, '(?s)(?:{trigger})(.*)$', 1), {relate.REACH})"
        parts.append(f"SELECT id, scope_id, '{kind}' AS relation, 's' AS role, unnest({_clean(_E(after))}) AS e, bad FROM cl WHERE {said} AND regexp_matches(c, '{trigger}')")
        if kind == "invalidates":
            before = f"right(regexp_extract(c, '(?s)^(.*?)(?:{trigger})', 1), {relate.REACH})"
            parts.append(f"SELECT id, scope_id, '{kind}', 's', unnest({_clean(_E(before))}), bad FROM cl WHERE {said} AND regexp_matches(c, '{trigger}') AND regexp_matches(c, '{relate.OLD}')")
        parts.append(f"SELECT id, scope_id, '{kind}', 't', unnest({_clean(_E('c'))}), bad FROM cl WHERE {said} AND regexp_matches(c, '{q(relate.ELIGIBLE[kind])}')")
    return " UNION ALL ".join(parts)


_RELATIONS = (
    f", vn AS {_VISIBLE_NOTES}, cl0 AS (SELECT id, scope_id, trim(unnest(regexp_split_to_array(lower(content), '[.!?;。！？；\\n]+'))) AS c FROM vn), cl AS (SELECT *, {_clean('list_concat(' + ', '.join(f"regexp_extract_all(c, '{q(p)}', 1)" for p in relate.EXCLUDED) + ')')} AS bad FROM cl0 WHERE c <> '' AND NOT regexp_matches(c, '{q(relate.PRESENTATION)}')), "
    f"m0 AS ({_mention_sql()}), me AS (SELECT DISTINCT id, scope_id, relation, role, e FROM m0 WHERE NOT list_contains(bad, e) AND {_DISTINCTIVE}) "
    + entity_cte("en", "id, scope_id", raw_entities("content"), "vn")
    + f", po AS (SELECT id, scope_id, e FROM (SELECT id, scope_id, unnest(es) AS e FROM en) WHERE {_DISTINCTIVE}), sz AS (SELECT scope_id, count(DISTINCT id) AS n FROM po GROUP BY 1), bl AS (SELECT scope_id, e FROM po JOIN sz USING (scope_id) GROUP BY scope_id, e, n HAVING n >= 20 AND count(DISTINCT id) >= greatest(12, ceil(0.03e0 * n))), "
    "typed AS (SELECT a.id AS s, b.id AS t, a.relation, a.e FROM me a JOIN me b ON a.scope_id = b.scope_id AND a.relation = b.relation AND a.e = b.e AND a.id <> b.id WHERE a.role = 's' AND b.role = 't' AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.scope_id = a.scope_id AND bl.e = a.e)) "
)


@register("n38_typed_relations", fx.with_("notes") + _RELATIONS + "SELECT s AS source, t AS target, relation AS relation_type, string_agg(e, ',' ORDER BY e) AS matched, CASE WHEN relation IN ('depends_on', 'owned_by') THEN 0.78e0 ELSE 0.72e0 END AS confidence FROM (SELECT DISTINCT * FROM typed) GROUP BY 1, 2, 3")
def n38(spark, d):
    n = fx.notes(spark, d).where(~policy.lifecycle().isin(*policy.ORDINARY_HIDDEN))
    blocked = graph.entity_frequency(relate.postings(n)).where("blocked").select("scope_id", "entity")
    return relate.typed_relations(n, blocked)


_LIKE = (
    _SEGMENTS + f", kn AS (SELECT id, scope_id, any_value(target) AS target, any_value(updated_at) AS at, any_value(lower(content)) AS low, list(DISTINCT {canon('u')}) AS ws FROM (SELECT id, scope_id, target, updated_at, content, unnest([t, {STEM}]) AS u FROM (SELECT id, scope_id, target, updated_at, content, unnest({tok('content')}) AS t FROM vn UNION ALL SELECT id, scope_id, target, updated_at, content, term FROM vn JOIN seg USING (id))) GROUP BY 1, 2), "
    "sh AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM (SELECT DISTINCT * FROM po) a JOIN (SELECT DISTINCT * FROM po) b ON a.scope_id = b.scope_id AND a.e = b.e AND a.id < b.id WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.scope_id = a.scope_id AND bl.e = a.e) GROUP BY 1, 2), "
    "pr AS (SELECT x.id AS a, y.id AS b, coalesce(shared, 0) AS shared, x.target AS ta, y.target AS tb, x.at AS ua, y.at AS ub, x.low AS la, y.low AS lb, greatest(len(list_intersect(x.ws, y.ws)) / CAST(len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws)) AS DOUBLE), 0.82e0 * len(list_intersect(x.ws, y.ws)) / least(len(x.ws), len(y.ws))) AS sim FROM kn x JOIN kn y ON x.scope_id = y.scope_id AND x.id < y.id LEFT JOIN sh ON sh.a = x.id AND sh.b = y.id), "
    "tp AS (SELECT a, b, CASE WHEN shared > 0 AND sim >= 0.40e0 THEN greatest(0.55e0, least(0.95e0, 0.45e0 + sim)) WHEN sim >= 0.68e0 THEN least(0.9e0, sim) END AS conf FROM pr WHERE ta = tb), "
    f"dirs AS (SELECT a AS s, b AS t, ua AS us, ub AS ut, la AS ls, lb AS lt, shared, sim FROM pr UNION ALL SELECT b, a, ub, ua, lb, la, shared, sim FROM pr), "
    f"edges AS (SELECT s AS source_memory_id, t AS target_memory_id, relation AS relation_type, CASE WHEN relation IN ('depends_on', 'owned_by') THEN 0.78e0 ELSE 0.72e0 END AS confidence FROM typed GROUP BY 1, 2, 3 UNION ALL SELECT a, b, 'same_topic', round(conf, 4) FROM tp WHERE conf IS NOT NULL UNION ALL SELECT b, a, 'same_topic', round(conf, 4) FROM tp WHERE conf IS NOT NULL UNION ALL SELECT s, t, 'supersedes', round(greatest(0.65e0, least(0.98e0, 0.55e0 + sim)), 4) FROM dirs WHERE shared > 0 AND us >= ut AND regexp_matches(ls, '{relate.SUPERSEDES}') AND (regexp_matches(lt, '{relate.OLD}') OR sim >= 0.24e0)) "
)


@register("q19_extracted_relations", fx.with_("notes") + _RELATIONS + _LIKE + "SELECT source_memory_id, target_memory_id, relation_type, round(confidence, 3) AS confidence FROM edges")
def q19(spark, d):
    return relate.extract(fx.notes(spark, d)).withColumn("confidence", F.round("confidence", 3))


_OLD = "old AS (SELECT source_memory_id, target_memory_id, relation_type, min(confidence) AS confidence, bool_and(CAST(source_memory_id AS BIGINT) % 3 <> 0) AS extracted FROM relations GROUP BY 1, 2, 3)"


@register("st8_rebuilt_relations", fx.with_("notes", "relations") + _RELATIONS + _LIKE + f", {_OLD}, focus AS (SELECT id FROM notes WHERE n % 4 = 0), kept AS (SELECT * FROM old WHERE NOT (extracted AND (source_memory_id IN (SELECT id FROM focus) OR target_memory_id IN (SELECT id FROM focus)))) SELECT source_memory_id, target_memory_id, relation_type, extracted FROM kept UNION ALL SELECT source_memory_id, target_memory_id, relation_type, true FROM edges e WHERE (source_memory_id IN (SELECT id FROM focus) OR target_memory_id IN (SELECT id FROM focus)) AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.source_memory_id = e.source_memory_id AND k.target_memory_id = e.target_memory_id AND k.relation_type = e.relation_type)")
def st8(spark, d):
    n = fx.notes(spark, d)
    old = fx.relations(spark, d).groupBy("source_memory_id", "target_memory_id", "relation_type").agg(F.min("confidence").alias("confidence"), F.bool_and(F.col("source_memory_id").cast("long") % 3 != 0).alias("extracted"))
    return relate.rebuilt(old, relate.extract(n), n.where("n % 4 = 0")).drop("confidence")


_REQUEST = ["concat('scope-', CAST(user_id % 7 AS STRING)) AS scope_id", "CAST(user_id AS STRING) AS id", "event_id AS revision", "ts AS at", "event_type"]
_REQ = f"SELECT {', '.join(_REQUEST)} FROM events"


@register("m14_rebuild_queue", f"WITH r AS ({_REQ.replace('STRING', 'VARCHAR')}), n AS (SELECT scope_id, id, max(revision) AS revision, count(*) - 1 AS superseded FROM r GROUP BY 1, 2), d AS (SELECT scope_id, id, max(revision) AS done FROM r WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT n.* FROM n LEFT JOIN d USING (scope_id, id) WHERE done IS NULL OR done < revision")
def m14(spark, d):
    r = fx.read(spark, d, "events").selectExpr(*_REQUEST)
    return relate.rebuild_queue(r, r.where("event_type = 'purchase'"))


@register("st8_drained_queue", f"WITH r AS ({_REQ.replace('STRING', 'VARCHAR')}), n AS (SELECT scope_id, id, max(revision) AS revision FROM r GROUP BY 1, 2), f AS (SELECT scope_id, id, count(*) AS failed, max(\"at\") AS last FROM r WHERE event_type = 'error' GROUP BY 1, 2), s AS (SELECT n.*, coalesce(failed, 0) AS failed, CASE WHEN coalesce(failed, 0) >= 3 THEN 'dead' WHEN last IS NULL OR last + INTERVAL '1' SECOND * CAST(pow(2, failed - 1) * 86400 AS BIGINT) <= TIMESTAMP '2024-01-28 00:00:00' THEN 'ready' ELSE 'deferred' END AS state FROM n LEFT JOIN f USING (scope_id, id)) "
    "SELECT scope_id, id, revision, failed, CASE WHEN state = 'ready' AND row_number() OVER (PARTITION BY scope_id, state ORDER BY revision, id) <= 5 THEN 'taken' WHEN state = 'dead' THEN 'dead' ELSE 'deferred' END AS outcome FROM s")
def st8d(spark, d):
    r = fx.read(spark, d, "events").selectExpr(*_REQUEST)
    queue = relate.rebuild_queue(r, r.limit(0)).drop("superseded")
    return relate.drain(queue, r.where("event_type = 'error'"), "2024-01-28 00:00:00", 5, 3, 86400)
