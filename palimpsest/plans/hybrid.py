"""Queries of recall: candidates of every channel, fusion, scores, reasons, explanations and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities as ent
from ..functions import intent, policy, text, vectors
from ..operators import grams, recall
from ..sources.scratch import written
from . import fixtures as fx
from .recalling import STEM, listed, tok
from .registry import register
from .scans import VISIBLE


def canon(u: str) -> str:
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in text.ALIASES.items())
    return f"coalesce((MAP {{{pairs}}})[{u}], {u})"


def canonical(keys: str, body: str, rows: str, drop: str = "[]::VARCHAR[]") -> str:
    """SQL: distinct canonical words u of ``body`` for ``keys``, without the raw words of a list."""
    return f"SELECT DISTINCT {keys}, {canon('u')} AS u FROM (SELECT {keys}, unnest([t, {STEM}]) AS u FROM (SELECT {keys}, unnest({tok(body)}) AS t FROM {rows}) WHERE NOT list_contains({drop}, t))"


def in_order(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def entity_cte(name: str, keys: str, raw: str, rows: str, most: int = 12) -> str:
    """SQL: ``name``(keys, es), the entities of a list of raw matches, in order of the first of each."""
    marks = ent.MARKS.replace("'", "''")
    normal = f"list_transform({raw}, lambda e: left(lower(regexp_replace(trim(trim(e), '{marks}'), '\\s+', ' ', 'g')), 96))"
    good = f"length(e) >= 2 AND NOT list_contains({listed(ent.COMMON)}, e) AND NOT contains(e, '_') AND NOT regexp_matches(e, '^(?:/tmp/|/home/|file://)') AND NOT (len(regexp_extract_all(e, '[a-z]+')) > 0 AND len(list_filter(regexp_extract_all(e, '[a-z]+'), lambda w: NOT list_contains({listed(ent.GENERIC)}, w))) = 0) AND NOT (regexp_matches(e, '{ent.CJK_NAME}') AND (length(e) > {ent.CJK_LETTERS} OR regexp_matches(e, '{ent.FRAGMENT}')))"
    return (
        f", {name}_l AS (SELECT {keys}, {normal} AS l FROM {rows}), {name}_e AS (SELECT {keys}, e, i FROM (SELECT {keys}, unnest(l) AS e, unnest(generate_series(1, len(l))) AS i FROM {name}_l) WHERE {good}), "
        f"{name}_p AS (SELECT {keys}, e, min(i) AS i FROM {name}_e GROUP BY ALL), {name}_n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS n FROM {name}_p), {name} AS (SELECT {keys}, list(e ORDER BY n) AS es FROM {name}_n WHERE n <= {most} GROUP BY {keys}) "
    )


ENTITY = ent.ENTITY


def raw_entities(column: str) -> str:
    return f"regexp_extract_all({column}, '{ENTITY}')"


#: The corpus, the curated notes and the questions of the recall queries.
BASE = (
    fx.with_("memories", "asked", "freshness", "claims", "relations")
    + f", corpus AS (SELECT * FROM memories WHERE {VISIBLE} AND source <> 'builtin-curated'), curated AS (SELECT * FROM memories WHERE {VISIBLE} AND source = 'builtin-curated'), "
    f"qx AS (SELECT query_id, query, scope_id, {in_order('x')} AS ws FROM (SELECT *, {tok('query')} AS x FROM asked)) "
)
BM25 = (
    f", toks AS (SELECT id, unnest({tok('content')}) AS term FROM corpus), dl AS (SELECT id, count(*) AS dl FROM toks GROUP BY id), total AS (SELECT (SELECT count(*) FROM corpus) AS n, (SELECT count(*) FROM toks) / CAST((SELECT count(*) FROM corpus) AS DOUBLE) AS avgdl), "
    "qt AS (SELECT query_id, unnest(ws[1:12]) AS term FROM qx), tf AS (SELECT id, term, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "bm AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS bm25 FROM tf JOIN df USING (term) JOIN dl USING (id) JOIN qt USING (term), total GROUP BY 1, 2), "
    "best AS (SELECT query_id, id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, updated_at DESC, id) AS rank FROM bm JOIN corpus USING (id)), "
    "bmn AS (SELECT query_id, id, bm25, CASE WHEN max(bm25) OVER w = min(bm25) OVER w THEN 1e0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS bm25_score FROM best WHERE rank <= 24 WINDOW w AS (PARTITION BY query_id)) "
)
_ALIAS_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in text.ALIASES.items())
LIKE = (
    f", qcanon AS ({canonical('query_id', 'query', 'asked')}), names AS (SELECT query_id, u AS t FROM qcanon UNION SELECT query_id, k FROM qcanon JOIN (VALUES {_ALIAS_ROWS}) a(k, v) ON v = u), "
    "ways AS (SELECT query_id, 'like' AS way, unnest(ws[1:6]) AS t FROM qx UNION ALL SELECT query_id, 'like', left(lower(query), 30) FROM qx WHERE len(ws) = 0 AND query <> '' UNION ALL SELECT names.query_id, 'alias', t FROM names JOIN qx USING (query_id) WHERE NOT list_contains(ws, t) AND NOT contains(lower(query), t)), "
    "held AS (SELECT DISTINCT query_id, way, id, updated_at FROM ways JOIN corpus ON contains(lower(content), t) OR contains(lower(summary), t)), sub AS (SELECT DISTINCT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, way ORDER BY updated_at DESC, id) AS r FROM held) WHERE r <= 24) "
)


def embedded(name: str, keys: str, body: str, rows: str, size: int = 256) -> str:
    """SQL: ``name``(keys, d, x), the hash embedding of ``body``, not yet of unit length."""
    return (
        f", {name}_w AS (SELECT {keys}, {canon('t')} AS w FROM (SELECT {keys}, unnest(list_distinct({tok(body)})) AS t FROM {rows})), "
        f"{name}_f AS (SELECT w, 'tok:' || w AS f, 1e0 AS x FROM (SELECT DISTINCT w FROM {name}_w) UNION ALL SELECT w, 'tri:' || substr(w, i, 3), 0.35e0 FROM (SELECT w, unnest(generate_series(1, greatest(length(w) - 2, 1))) AS i FROM (SELECT DISTINCT w FROM {name}_w))), "
        f"{name}_d AS (SELECT w, d, sum(x) AS x FROM (SELECT w, CAST('0x' || substr(sha1(f), 1, 8) AS BIGINT) % {size} AS d, CASE WHEN CAST('0x' || substr(sha1(f), 9, 2) AS BIGINT) % 2 = 1 THEN -x ELSE x END AS x FROM {name}_f) GROUP BY 1, 2), "
        f"{name} AS (SELECT {keys}, d, sum(x) AS x FROM {name}_w JOIN {name}_d USING (w) GROUP BY ALL) "
    )


VECTOR = (
    embedded("dv", "id", "content", "corpus")
    + embedded("qv", "query_id", "query", "asked")
    + ", dn AS (SELECT id, sqrt(sum(x * x)) AS n FROM dv GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM qv GROUP BY 1), "
    "cosines AS (SELECT query_id, id, sum(qv.x * dv.x) / (any_value(qn.n) * any_value(dn.n)) AS c FROM qv JOIN dv USING (d) JOIN qn USING (query_id) JOIN dn USING (id) GROUP BY 1, 2), "
    "near AS (SELECT query_id, id, greatest(0e0, 1 - d) AS vector FROM (SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM (SELECT query_id, id, round(least(2e0, greatest(0e0, 1 - c)), 6) AS d FROM cosines)) WHERE r <= 12 AND 1 - d >= 0.12e0) "
)
LEXICAL = (
    f", qset AS ({canonical('query_id', 'query', 'asked', listed((*text.SEMANTIC_STOPWORDS, *text.CJK_STOPWORDS)))}), qmark AS (SELECT query_id, u, NOT list_contains({listed(text.QUERY_STOPWORDS)}, u) AS good FROM qset), "
    "qinf AS (SELECT query_id, u FROM qmark m WHERE good OR NOT EXISTS (SELECT 1 FROM qmark o WHERE o.query_id = m.query_id AND o.good)), qsize AS (SELECT query_id, count(*) AS n FROM qinf GROUP BY 1) "
)
_ZONE = intent._ZONE.replace("'", "''")
_ZONE_ANSWER = intent.TIMEZONE_ANSWER.replace("(?is)", "(?s)")


def lexical(pairs: str, rows: str, name: str) -> str:
    """SQL: ``name``, the pairs with the rows of their ids and their lexical score."""
    phrase = "CASE WHEN query <> '' AND contains(hay, lower(query)) THEN 0.35e0 ELSE 0e0 END"
    zone = f"regexp_matches(lower(query), '\\btime\\s*zone\\b|\\btimezone\\b|时区') AND (NOT contains(lower(query), 'server') OR contains(hay, 'server')) AND regexp_matches(hay, '{_ZONE_ANSWER}')"
    return (
        f", {name}_u AS ({canonical('id', 'hay', '(SELECT id, lower(summary || chr(10) || content) AS hay FROM ' + rows + ' WHERE id IN (SELECT id FROM ' + pairs + '))')}), "
        f"{name}_h AS (SELECT query_id, id, count(*) AS hits FROM {pairs} JOIN qinf USING (query_id) JOIN {name}_u USING (id, u) GROUP BY 1, 2), "
        f"{name}_r AS (SELECT p.*, r.* EXCLUDE (id, scope_id), r.scope_id AS memory_scope, query, qx.scope_id AS query_scope, lower(summary || chr(10) || content) AS hay FROM {pairs} p JOIN {rows} r USING (id) JOIN qx USING (query_id)), "
        f"{name}_z AS (SELECT *, {zone} AS intent_matched, regexp_matches(lower(query), '\\btime\\s*zone\\b|\\btimezone\\b|时区') AS intent_asked FROM {name}_r), "
        f"{name} AS (SELECT z.*, greatest(0e0, least(1e0, 0.72e0 * coalesce(hits, 0) / coalesce(n, 1) + {phrase} + CASE WHEN intent_matched THEN 0.18e0 ELSE 0e0 END + CASE WHEN source = 'builtin-curated' THEN 0.18e0 WHEN source LIKE 'tool%' THEN 0.08e0 ELSE 0.02e0 END "
        f"+ CASE target WHEN 'user' THEN 0.08e0 WHEN 'memory' THEN 0.06e0 WHEN 'general' THEN -0.04e0 ELSE 0.055e0 END)) AS raw, hits FROM {name}_z z LEFT JOIN {name}_h USING (query_id, id) LEFT JOIN qsize USING (query_id)) "
    )


POOL = (
    ", ids AS (SELECT query_id, id, bm25_score, vector, b.id IS NOT NULL OR s.id IS NOT NULL AS from_text FROM bmn b FULL JOIN sub s USING (query_id, id) FULL JOIN near n USING (query_id, id)) "
    + lexical("ids", "corpus", "lx")
    + ", l1 AS (SELECT *, CASE WHEN from_text AND round(raw, 6) >= 0.09e0 THEN raw ELSE 0e0 END AS l0 FROM lx), l2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(l0, 6) DESC, id) AS lp FROM l1), "
    "pool AS (SELECT * EXCLUDE (raw, l0, lp, hits, bm25_score, vector, from_text), CASE WHEN l0 > 0 AND lp <= 12 THEN l0 ELSE 0e0 END AS lexical, CASE WHEN l0 > 0 AND lp <= 12 THEN bm25_score END AS bm25_score, coalesce(vector, 0e0) AS vector, false AS curated FROM l2) "
    + ", cpairs AS (SELECT DISTINCT query_id, c.id FROM (" + canonical("id", "summary || chr(10) || content", "curated") + ") c JOIN qinf USING (u)) "
    + lexical("cpairs", "curated", "cx")
    + ", cbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, id) AS lp FROM cx WHERE round(raw, 6) >= 0.18e0) WHERE lp <= 12), "
    "every AS (SELECT * FROM pool WHERE lexical > 0 OR vector > 0 UNION ALL BY NAME SELECT * EXCLUDE (raw, lp, hits) REPLACE ('curated:' || id AS id), raw AS lexical, NULL AS bm25_score, 0e0 AS vector, true AS curated FROM cbest), "
    "prec AS (SELECT memory_id, bool_or(status = 'current' AND retired_at IS NULL AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-02-15 00:00:00') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-02-15 00:00:00')) AS temporal_current FROM claims GROUP BY 1), "
    "kept0 AS (SELECT e.*, temporal_current FROM every e LEFT JOIN prec ON prec.memory_id = e.id WHERE temporal_current IS NULL OR temporal_current) "
)
FUSED = (
    ", lists AS (SELECT query_id, id, 'lexical' AS signal, round(lexical, 6) AS s FROM kept0 WHERE lexical > 0 AND NOT curated UNION ALL SELECT query_id, id, 'vector', round(vector, 6) FROM kept0 WHERE vector > 0 UNION ALL SELECT query_id, id, 'bm25', round(bm25_score, 6) FROM kept0 WHERE bm25_score > 0 UNION ALL SELECT query_id, id, 'curated', round(lexical, 6) FROM kept0 WHERE curated), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, signal ORDER BY s DESC, id) AS r FROM lists), summed AS (SELECT query_id, id, sum(CASE WHEN signal = 'curated' THEN 1.25e0 ELSE 1e0 END / (60 + r)) AS raw FROM placed GROUP BY 1, 2 HAVING count(DISTINCT signal) >= 2), "
    "rrf AS (SELECT query_id, id, raw / max(raw) OVER (PARTITION BY query_id) AS rrf FROM summed), kept1 AS (SELECT k.*, coalesce(rrf, 0e0) AS rrf, CASE WHEN curated THEN k.id WHEN target = 'general' THEN 'scratch:' || dedup_key ELSE 'durable:' || dedup_key END AS key FROM kept0 k LEFT JOIN rrf USING (query_id, id)), "
    "kept2 AS (SELECT * EXCLUDE (lexical, vector, rrf, bm25_score), max(lexical) OVER g AS lexical, max(vector) OVER g AS vector, max(rrf) OVER g AS rrf, coalesce(first_value(bm25_score) OVER (PARTITION BY query_id, key ORDER BY bm25_score IS NULL, updated_at DESC, id DESC), 0e0) AS bm25_score, row_number() OVER (PARTITION BY query_id, key ORDER BY updated_at DESC, id DESC) AS nth FROM kept1 WINDOW g AS (PARTITION BY query_id, key)), "
    "kept3 AS (SELECT * REPLACE (lexical * w AS lexical, vector * w AS vector, rrf * w AS rrf, bm25_score * w * CASE WHEN intent_asked AND NOT intent_matched THEN 0.25e0 ELSE 1e0 END AS bm25_score) FROM (SELECT *, CASE WHEN target = 'general' THEN 0.35e0 ELSE 1e0 END AS w FROM kept2 WHERE nth = 1 AND (target <> 'general' OR memory_scope = query_scope))) "
)
SCORED = (
    entity_cte("e_doc", "id", raw_entities("content"), "(SELECT DISTINCT id, content FROM kept3)")
    + entity_cte("e_raw", "query_id", raw_entities("query"), "asked")
    + entity_cte("e_query", "query_id", f"list_concat(coalesce(es, []), list_filter({tok('query')}, lambda t: length(t) >= 3))", "asked LEFT JOIN e_raw USING (query_id)", 8)
    + ", k4 AS (SELECT kept3.*, coalesce(d.es, []) AS es, coalesce(q.es, []) AS qs FROM kept3 LEFT JOIN e_doc d USING (id) LEFT JOIN e_query q USING (query_id)), "
    "held_e AS (SELECT query_id, id, qs, unnest(es) AS e FROM k4), g1 AS (SELECT DISTINCT query_id, id FROM held_e WHERE list_contains(qs, e)), g2 AS (SELECT DISTINCT h.query_id, h.id FROM held_e h WHERE (h.query_id, e) IN (SELECT (query_id, e) FROM held_e JOIN g1 USING (query_id, id))), "
    "g3 AS (SELECT DISTINCT h.query_id, h.id FROM held_e h WHERE (h.query_id, e) IN (SELECT (query_id, e) FROM held_e JOIN g2 USING (query_id, id))), gs AS (SELECT query_id, id, max(g) AS graph FROM (SELECT *, 1e0 AS g FROM g1 UNION ALL SELECT *, 0.5e0 FROM g2 UNION ALL SELECT *, 1e0 / 3 FROM g3) GROUP BY 1, 2), "
    "contra AS (SELECT DISTINCT unnest([source_memory_id, target_memory_id]) AS id FROM relations WHERE relation_type = 'contradicts'), "
    "k5 AS (SELECT k4.*, coalesce(graph, 0e0) AS graph, f.status, f.truth_type, contra.id IS NOT NULL AS contradicts, CASE WHEN len(qs) = 0 OR len(es) = 0 THEN 0e0 ELSE 0.06e0 * len(list_intersect(qs, es)) / len(qs) END AS entity_bonus, "
    "CASE WHEN json_valid(metadata) THEN (CAST(json_extract_string(metadata, '$.confidence') AS DOUBLE) + CAST(json_extract_string(metadata, '$.importance') AS DOUBLE)) / 2 END AS quality, "
    "CASE WHEN vector <= 0 AND (lexical > 0 OR bm25_score > 0) THEN greatest(lexical, bm25_score) WHEN lexical <= 0 AND bm25_score <= 0 THEN vector ELSE greatest(0e0, least(1e0, 0.45e0 * lexical + 0.55e0 * vector + 0.15e0 * bm25_score)) END AS b0 FROM k4 LEFT JOIN gs USING (query_id, id) LEFT JOIN freshness f ON f.id = k4.id LEFT JOIN contra ON contra.id = k4.id), "
    "k6 AS (SELECT *, greatest(0e0, least(1e0, CASE WHEN rrf > 0 THEN b0 * 0.82e0 + rrf * 0.18e0 ELSE b0 END)) AS pre, CASE WHEN status IS NULL THEN 0.10e0 WHEN status IN ('current', 'verified') THEN 0e0 WHEN truth_type = 'operational_status' THEN 0.55e0 WHEN status = 'needs_live_check' THEN 0.18e0 WHEN status = 'expired' THEN 0.45e0 ELSE 0.35e0 END AS penalty FROM k5), "
    "k7 AS (SELECT *, greatest(0e0, least(1e0, CASE WHEN quality IS NULL THEN pre ELSE greatest(0e0, least(1e0, pre + (quality - 0.5e0) * 0.08e0)) END + entity_bonus + 0.04e0 * graph)) * (1 - penalty) AS base FROM k6), "
    r"pr AS (SELECT *, list_transform(regexp_extract_all(query, '(?i)\bproject[\s:_-]+([a-z0-9][a-z0-9-]{1,40})', 1), lambda p: lower(p)) AS qp, list_transform(regexp_extract_all(content || chr(10) || summary, '(?i)\bproject[\s:_-]+([a-z0-9][a-z0-9-]{1,40})', 1), lambda p: lower(p)) AS mp FROM k7), "
    "k8 AS (SELECT *, CASE WHEN len(qp) > 0 AND len(mp) > 0 AND len(list_intersect(qp, mp)) = 0 THEN 'entity_scope_mismatch' WHEN lexical <= 0 AND vector > 0 AND round(base, 6) < 0.70e0 THEN 'vector_only_below_min_score' WHEN round(base, 6) < 0.18e0 THEN 'below_min_score' END AS rejected FROM pr), "
    f"hints AS (SELECT query_id, CASE WHEN h > 0 THEN least(0.06e0, 0.03e0 + 0.015e0 * h) ELSE 0e0 END AS fw, now FROM (SELECT query_id, greatest(len(list_intersect(ws, {listed(intent.FRESHNESS_HINTS)})), CAST(now AS INT)) AS h, now FROM (SELECT query_id, ws, regexp_matches(lower(query), '\\b(current|currently|latest|newest|now|today)\\b|\\btime\\s*zone\\b|\\btimezone\\b') AND NOT regexp_matches(lower(query), '\\b(previously|before|history|historical|formerly|used\\s+to|as\\s+of)\\b') AS now FROM qx))), "
    "k9 AS (SELECT k8.*, fw, now, (epoch(updated_at) - min(epoch(updated_at)) OVER g) / nullif(max(epoch(updated_at)) OVER g - min(epoch(updated_at)) OVER g, 0) AS pos FROM k8 JOIN hints USING (query_id) WINDOW g AS (PARTITION BY query_id, rejected IS NULL)), "
    "k10 AS (SELECT *, CASE WHEN rejected IS NOT NULL OR pos IS NULL OR fw <= 0 OR base <= 0 THEN 0e0 ELSE least(fw * pos * least(1e0, base / 0.6e0), 0.06e0, 0.12e0 * base) END AS recency, CASE WHEN now AND intent_matched THEN CASE WHEN coalesce(temporal_current, false) OR coalesce(status, '') = 'current' THEN 4 WHEN source = 'builtin-curated' AND target IN ('user', 'memory') THEN 3 ELSE 1 END ELSE 0 END AS crank FROM k9), "
    "ranked AS (SELECT *, base + recency AS score, CASE WHEN rejected IS NULL THEN row_number() OVER (PARTITION BY query_id, rejected IS NULL ORDER BY crank DESC, round(base + recency, 6) DESC, intent_matched DESC, round(base, 6) DESC, updated_at DESC, id DESC) END AS place FROM k10) "
)
RECALL = BASE + BM25 + LIKE + VECTOR + LEXICAL + POOL + FUSED + SCORED


def stores(spark, d):
    m = fx.memories(spark, d)
    return m.where("source <> 'builtin-curated'"), m.where("source = 'builtin-curated'")


def recalled(spark, d):
    corpus, notes = stores(spark, d)
    return recall.recall(corpus, fx.asked(spark, d), fx.AS_OF, notes=notes, claims=fx.claims(spark, d), relation_rows=fx.relations(spark, d), freshness=fx.freshness(spark, d))


@register("q1_hybrid_recall", RECALL + "SELECT query_id, id, round(score, 9) AS score, place FROM ranked WHERE place <= 5")
def q1(spark, d):
    return recalled(spark, d).where("place IS NOT NULL").select("query_id", "id", F.round("score", 9).alias("score"), "place")


_PARTS = ("lexical", "vector", "bm25_score", "rrf", "graph", "entity_bonus", "penalty", "base_score", "recency_bonus", "score")


@register("q13_explained_recall", RECALL + "SELECT query_id, id, place, rejected, contradicts, round(lexical, 9) AS lexical, round(vector, 9) AS vector, round(bm25_score, 9) AS bm25_score, round(rrf, 9) AS rrf, round(graph, 9) AS graph, round(entity_bonus, 9) AS entity_bonus, round(penalty, 9) AS penalty, round(base, 9) AS base_score, round(recency, 9) AS recency_bonus, round(score, 9) AS score FROM ranked WHERE place <= 5 OR place IS NULL")
def q13(spark, d):
    return recalled(spark, d).select("query_id", "id", "place", "rejected", "contradicts", *(F.round(c, 9).alias(c) for c in _PARTS))


@register("n48_funnel", RECALL + ", f AS (SELECT unnest(['entity_scope_mismatch', 'freshness_strict_excluded', 'relation_contradiction_suppressed', 'vector_only_below_min_score', 'below_min_score']) AS filter), shown AS (SELECT * FROM ranked WHERE place <= 5 OR place IS NULL) SELECT query_id, filter, count(CASE WHEN rejected = filter THEN 1 END) AS count FROM shown, f GROUP BY 1, 2")
def n48(spark, d):
    return recall.funnel(recalled(spark, d)).select("query_id", "filter", "count")


@register("q14_known_answers", RECALL + ", labels AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS id FROM queries, documents WHERE contains(text, query)), shown AS (SELECT query_id, id, place, sum(length(summary)) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS used FROM ranked WHERE place <= 5), "
    "r AS (SELECT l.query_id, min(place) AS rank, min(used) AS used FROM labels l LEFT JOIN shown s ON s.query_id = l.query_id AND s.id = l.id GROUP BY 1), bad AS (SELECT count(*) AS forbidden FROM shown s JOIN memories m ON m.id = s.id WHERE m.target = 'ops' AND place <= 3) "
    "SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 3 THEN 1e0 ELSE 0e0 END), 6) AS recall, round(avg(CASE WHEN rank = 1 THEN 1e0 ELSE 0e0 END), 6) AS first, round(avg(CASE WHEN rank <= 3 THEN 1e0 / rank ELSE 0e0 END), 6) AS mrr, round(avg(CASE WHEN rank <= 3 AND used <= 400 THEN 1e0 ELSE 0e0 END), 6) AS budget_hits, (SELECT forbidden FROM bad) AS forbidden FROM r")
def q14(spark, d):
    shown = recalled(spark, d).where("place IS NOT NULL").select("query_id", "id", F.col("place").alias("rank"), F.char_length("summary").alias("chars"))
    m = fx.memories(spark, d)
    labels = recall.against(m.select("id", "content"), fx.queries(spark, d), F.contains(F.col("content"), F.col("query"))).select("query_id", "id")
    forbidden = shown.select("query_id", "id").join(m.where("target = 'ops'"), "id", "left_semi")
    return recall.retrieval_metrics(shown, labels, 3, forbidden, 400)


@register("q8_context", RECALL + ", shown AS (SELECT *, sum(length(summary) + 1) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS used FROM ranked WHERE place <= 5), fit AS (SELECT * FROM shown WHERE used <= 900), named AS (SELECT query_id, e, count(*) AS n FROM (SELECT query_id, unnest(es) AS e FROM fit) GROUP BY 1, 2) SELECT query_id, e AS entity, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, e) AS r FROM named) WHERE r <= 10")
def q8(spark, d):
    from ..operators import scan

    shown = recalled(spark, d).where("place IS NOT NULL")
    fit = scan.fits_budget(shown, "query_id", "place", F.char_length("summary").cast("long") + 1, 900)
    named = fit.select("query_id", F.explode("entities").alias("entity")).groupBy("query_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    return recall.top(named, "query_id", 10, F.desc("n"), F.col("entity")).select("query_id", "entity", "n")


@register("q2_lexical_candidates", BASE + BM25 + LIKE + "SELECT query_id, id, round(bm25_score, 9) AS bm25_score FROM bmn FULL JOIN sub USING (query_id, id)")
def q2(spark, d):
    corpus, _ = stores(spark, d)
    found = recall.lexical_candidates(corpus.where(policy.ordinary_visible()), fx.asked(spark, d), 12)
    return found.select("query_id", "id", F.round("bm25_score", 9).alias("bm25_score"))


@register("o3_bm25_by_recency", BASE + BM25 + "SELECT query_id, id, rank, round(bm25_score, 9) AS score FROM bmn JOIN best USING (query_id, id)")
def o3(spark, d):
    corpus, _ = stores(spark, d)
    best = recall.ranked_by_bm25(corpus.where(policy.ordinary_visible()), fx.asked(spark, d), 24, recent=True)
    return recall.minmax(best, "query_id", "bm25", "score").select("query_id", "id", "rank", F.round("score", 9).alias("score"))


@register("q3_text_candidates", BASE + VECTOR + "SELECT query_id, id, round(vector, 9) AS vector FROM near")
def q3t(spark, d):
    corpus, _ = stores(spark, d)
    near = recall.text_candidates(corpus.where(policy.ordinary_visible()), fx.asked(spark, d), 12)
    return near.select("query_id", "id", F.round(1 - F.col("distance"), 9).alias("vector")).where("vector >= 0.12")


_COS = "1 - list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[])) * list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[])))"
_COS = _COS.format("a.embedding", "b.embedding")


@register("q3_vector_candidates", f"WITH p AS (SELECT b.vec_id AS q, a.vec_id AS v, round({_COS}, 6) AS d FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) SELECT CAST(q AS VARCHAR) AS query_id, CAST(v AS VARCHAR) AS id, round(greatest(0e0, 1 - d), 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, CAST(v AS VARCHAR)) AS rank FROM p) WHERE rank <= 8 AND 1 - d >= 0.12e0")
def q3(spark, d):
    v = fx.vectors(spark, d)
    best = recall.vector_candidates(v, fx.every_50th(v).select(F.col("id").alias("query_id"), "vector"), 8)
    return best.where("1 - distance >= 0.12").select("query_id", "id", F.round(F.greatest(F.lit(0.0), 1 - F.col("distance")), 4).alias("score"), "rank")


@register("o5_vector_top_by_scope", "WITH p AS (SELECT b.vec_id AS q, a.vec_id AS v, a.label, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS d FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q, label ORDER BY d, CAST(v AS VARCHAR)) AS r FROM p) SELECT CAST(q AS VARCHAR) AS query_id, CAST(v AS VARCHAR) AS id, 'label-' || CAST(label AS VARCHAR) AS scope_id, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, CAST(v AS VARCHAR)) AS place FROM r WHERE r <= 3) WHERE place <= 12")
def o5(spark, d):
    v = fx.vectors(spark, d)
    near = recall.vector_candidates(v, fx.every_50th(v).select(F.col("id").alias("query_id"), "vector"), 3, "l2", "scope_id").drop("rank")
    best = near.groupBy("query_id", "id").agg(F.min_by("scope_id", F.struct("distance", "scope_id")).alias("scope_id"), F.min("distance").alias("distance"))
    return recall.top(best, "query_id", 12, F.col("distance"), F.col("id")).select("query_id", "id", "scope_id", F.col("rank").alias("place"))


@register("n21_distances", f"SELECT b.vec_id AS a, a.vec_id AS b, round({_COS}, 6) AS cosine, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS l2, round(1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0")
def n21(spark, d):
    v = fx.vectors(spark, d).select(F.col("n").alias("id"), "vector")
    pairs = recall.vector_distances(v, fx.every_50th(v).withColumnRenamed("id", "query_id"), ("cosine", "l2", "dot"))
    return pairs.withColumnsRenamed({"query_id": "a", "id": "b"})


@register("p17_vector_hits", fx.with_("memories", "vectors") + f", h AS (SELECT b.id AS query_id, a.id, 1 - round({_COS.replace('a.embedding', 'a.vector').replace('b.embedding', 'b.vector')}, 6) AS score FROM vectors a, vectors b WHERE b.n % 50 = 0) SELECT query_id, h.id, round(score, 9) AS score FROM h JOIN memories m ON m.id = h.id WHERE {VISIBLE} AND score >= 0.12e0")
def p17(spark, d):
    v = fx.vectors(spark, d)
    seen = v.select("id", "vector").join(fx.memories(spark, d).where(policy.ordinary_visible()).select("id"), "id", "left_semi")
    near = recall.vector_distances(written(seen), fx.every_50th(v).select(F.col("id").alias("query_id"), "vector"), ("cosine",), 0.88)
    return near.select("query_id", "id", F.round(1 - F.col("cosine"), 9).alias("score")).where("score >= 0.12")


@register("n22_hash_embedding", fx.with_("memories") + embedded("dv", "id", "content", "memories", 64) + ", l AS (SELECT id, sqrt(sum(x * x)) AS n FROM dv GROUP BY 1) SELECT id, round(sum(abs(x)) / any_value(n), 6) AS total, round(max(abs(x)) / any_value(n), 6) AS largest FROM dv JOIN l USING (id) WHERE n > 0 GROUP BY id")
def n22(spark, d):
    v = fx.memories(spark, d).select("id", vectors.embed(F.col("content"), vectors.embedder(dimensions=64)).alias("v")).where(vectors.norm(F.col("v")) > 0)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x))
    return v.select("id", F.round(total, 6).alias("total"), F.round(F.array_max(F.transform("v", lambda x: F.abs(x))), 6).alias("largest"))


@register("k18_vector_generation", fx.with_("memories") + f", c AS (SELECT * FROM memories WHERE {VISIBLE})" + embedded("dv", "id", "content", "c", 32) + ", l AS (SELECT id, sqrt(sum(x * x)) AS n FROM dv GROUP BY 1) SELECT c.id, 32 AS dimensions, round(coalesce(max(x * x) / any_value(n * n), 0), 6) AS largest FROM c LEFT JOIN dv USING (id) LEFT JOIN l USING (id) GROUP BY c.id")
def k18(spark, d):
    from ..sources.stores import FolderStore

    m = fx.memories(spark, d).where(policy.ordinary_visible())
    store = FolderStore.new(spark)
    store.upsert(m.select("id", "scope_id", vectors.embed(F.col("content"), vectors.embedder(dimensions=32)).alias("vector"), "updated_at"))
    return store.read().select("id", F.size("vector").alias("dimensions"), F.round(F.array_max(F.transform("vector", lambda x: x * x)), 6).alias("largest"))


@register("q4_curated_candidates", BASE + LEXICAL + ", cpairs AS (SELECT DISTINCT query_id, c.id FROM (" + canonical("id", "summary || chr(10) || content", "curated") + ") c JOIN qinf USING (u)) " + lexical("cpairs", "curated", "cx") + "SELECT query_id, 'curated:' || id AS id, round(raw, 9) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, id) AS place FROM cx WHERE round(raw, 6) >= 0.18e0) WHERE place <= 12")
def q4(spark, d):
    _, notes = stores(spark, d)
    found = recall.curated_candidates(notes.where(policy.ordinary_visible()), fx.asked(spark, d), 12)
    return found.select("query_id", "id", F.round("lexical", 9).alias("score"), F.col("rank").alias("place"))


@register("q5_temporal_overlay", fx.with_("memories", "claims") + f", c AS (SELECT memory_id, bool_or(status = 'current' AND retired_at IS NULL AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-02-15 00:00:00') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-02-15 00:00:00')) AS current FROM claims GROUP BY 1) SELECT m.id, CASE WHEN current THEN 'promoted' WHEN NOT current THEN 'suppressed' ELSE 'plain' END AS overlay FROM memories m LEFT JOIN c ON c.memory_id = m.id WHERE {VISIBLE}")
def q5(spark, d):
    m = fx.memories(spark, d).where(policy.ordinary_visible()).select("id")
    rows = m.join(recall.precedence(fx.claims(spark, d), fx.AS_OF), F.col("id") == F.col("memory_id"), "left")
    return rows.select("id", F.when(F.col("temporal_current"), "promoted").when(~F.col("temporal_current"), "suppressed").otherwise("plain").alias("overlay"))


@register("j15_merged_candidates", BASE + BM25 + LIKE + VECTOR + LEXICAL + POOL + FUSED + "SELECT query_id, id, round(lexical, 9) AS lexical, round(vector, 9) AS vector, round(rrf, 9) AS rrf, round(coalesce(bm25_score, 0), 9) AS bm25_score FROM kept2 WHERE nth = 1")
def j15(spark, d):
    rows = recalled_candidates(spark, d)
    return rows.select("query_id", "id", *(F.round(c, 9).alias(c) for c in ("lexical", "vector", "rrf", "bm25_score")))


def recalled_candidates(spark, d):
    corpus, notes = stores(spark, d)
    return recall.candidates(corpus, fx.asked(spark, d), fx.AS_OF, notes=notes, claims=fx.claims(spark, d))


@register("p10_match_any", fx.with_("memories", "queries") + f"SELECT DISTINCT query_id, id FROM (SELECT query_id, unnest({in_order(tok('query'))}[1:12]) AS t FROM queries) q JOIN (SELECT DISTINCT id, unnest({tok('content')}) AS t FROM memories) m USING (t)")
def p10(spark, d):
    rows = fx.memories(spark, d).select("id", text.query_tokens("content").alias("words"))
    asked = fx.queries(spark, d).select("query_id", F.slice(text.query_tokens("query"), 1, 12).alias("terms"))
    index = rows.select("id", F.explode("words").alias("term"))
    return recall.in_blocks(asked, lambda q: index.join(F.broadcast(q.select("query_id", F.explode("terms").alias("term"))), "term").select("query_id", "id").distinct())


@register("p8_like_any", BASE + ", ways AS (SELECT query_id, unnest(ws[1:6]) AS t FROM qx UNION ALL SELECT query_id, left(lower(query), 30) FROM qx WHERE len(ws) = 0 AND query <> '') SELECT query_id, count(DISTINCT id) AS n, max(id) AS last FROM ways JOIN corpus ON contains(lower(content), t) OR contains(lower(summary), t) GROUP BY 1")
def p8(spark, d):
    return held(spark, d, recall.like_terms("query")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


def held(spark, d, terms):
    """The visible texts that hold one of each question's terms, by question."""
    corpus, _ = stores(spark, d)
    asked = fx.asked(spark, d).select("query_id", F.explode(terms).alias("term"))
    found = grams.holding(corpus.where(policy.ordinary_visible()), asked)
    return found.join(F.broadcast(asked), "term").select("query_id", "id").distinct().groupBy("query_id")


@register("p9_alias_like", BASE + LIKE + "SELECT query_id, count(DISTINCT id) AS n FROM ways JOIN corpus ON contains(lower(content), t) OR contains(lower(summary), t) WHERE way = 'alias' GROUP BY 1")
def p9(spark, d):
    return held(spark, d, recall.alias_terms("query")).agg(F.count(F.lit(1)).alias("n"))


@register("p11_general_policy", fx.with_("memories", "asked") + ", i AS (SELECT *, coalesce(CASE WHEN json_valid(metadata) THEN CAST(json_extract_string(metadata, '$.importance') AS DOUBLE) END, 0) AS importance FROM memories) SELECT query_id, mode, count(*) AS n, round(sum(CASE WHEN target = 'general' THEN 0.35e0 ELSE 1e0 END), 4) AS weight FROM i, asked a, (SELECT unnest(['same-scope', 'never', 'always']) AS mode) WHERE target <> 'general' OR mode = 'always' OR mode = 'same-scope' AND i.scope_id = a.scope_id AND importance >= 0.4e0 GROUP BY 1, 2")
def p11(spark, d):
    m = fx.memories(spark, d).select("scope_id", "target", "metadata")
    asked = fx.asked(spark, d).select("query_id", F.col("scope_id").alias("own"), F.explode(F.array(*map(F.lit, policy.GENERAL_MODES))).alias("mode"))
    rows = recall.against(m, asked, policy.general_allowed(F.col("target"), F.col("scope_id"), F.col("own"), F.col("mode"), policy.json_text("metadata", "$.importance").cast("double"), 0.4))
    return rows.groupBy("query_id", "mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(F.col("target") == "general", recall.GENERAL_WEIGHT).otherwise(1.0)), 4).alias("weight"))


@register("n8_weighted_overlap", fx.with_("queries", "memories") + f", q AS (SELECT query_id, query, list_filter(list_distinct({tok('query')}), lambda x: NOT list_contains({listed((*text.SEMANTIC_STOPWORDS, *text.CJK_STOPWORDS))}, x)) AS ts FROM queries), u AS (SELECT DISTINCT id, u FROM (SELECT id, unnest([t, {STEM}]) AS u FROM (SELECT id, unnest({tok('summary')}) AS t FROM memories))), "
    f"z AS (SELECT query_id, t, {STEM} AS st FROM (SELECT query_id, unnest(ts) AS t FROM q)), w AS (SELECT query_id, sum(least(8, greatest(2, length(t)))) AS w FROM z GROUP BY 1), "
    "hits AS (SELECT query_id, m.id, t FROM z JOIN memories m ON contains(lower(summary), t) UNION SELECT query_id, u.id, t FROM z JOIN u ON u.u = z.st), h AS (SELECT query_id, id, sum(least(8, greatest(2, length(t)))) AS h FROM hits GROUP BY 1, 2), "
    "p AS (SELECT q.query_id, m.id, contains(lower(summary), lower(query)) AS phrase FROM q, memories m WHERE len(ts) > 0) "
    "SELECT query_id, id, round(CASE WHEN phrase THEN 1e0 ELSE CAST(coalesce(h, 0) AS DOUBLE) / w END, 6) AS overlap FROM p JOIN w USING (query_id) LEFT JOIN h USING (query_id, id) WHERE phrase OR h > 0")
def n8(spark, d):
    m = fx.memories(spark, d).select("id", "summary")
    q = fx.queries(spark, d).where(F.size(text.semantic_tokens("query")) > 0)
    return recall.word_overlaps(m.withColumnRenamed("summary", "content"), q).select("query_id", "id", F.round("overlap", 6).alias("overlap")).where("overlap > 0")


@register("n9_final_scores", "SELECT event_id, round(CASE WHEN v <= 0 AND (l > 0 OR b > 0) THEN greatest(l, b) WHEN l <= 0 AND b <= 0 THEN v ELSE least(1e0, 0.45e0 * l + 0.55e0 * v + 0.15e0 * b) END * CASE WHEN r > 0 THEN 0.82e0 ELSE 1e0 END + 0.18e0 * r, 6) AS score FROM (SELECT event_id, event_id % 11 / 10e0 AS l, event_id % 7 / 6e0 AS v, event_id % 5 / 4e0 AS b, event_id % 3 / 2e0 AS r FROM events)")
def n9(spark, d):
    part = lambda n: (F.col("event_id") % n) / (n - 1.0)
    return fx.read(spark, d, "events").select("event_id", F.round(recall.final_score(part(11), part(7), part(5), part(3)), 6).alias("score"))


_STATUS = "CASE event_id % 6 WHEN 0 THEN 'current' WHEN 1 THEN 'stale' WHEN 2 THEN 'expired' ELSE 'untracked' END"


@register("p13_reject_reasons", f"SELECT event_id, CASE WHEN {_STATUS} IN ('stale', 'expired') THEN 'freshness_strict_excluded' WHEN event_id % 17 = 0 THEN 'relation_contradiction_suppressed' WHEN event_id % 19 = 0 THEN 'entity_scope_mismatch' WHEN event_id % 4 = 0 AND event_id % 9 / 9e0 < 0.7 THEN 'vector_only_below_min_score' WHEN event_id % 9 / 9e0 < 0.18 THEN 'below_min_score' END AS reason FROM events")
def p13(spark, d):
    n = F.col("event_id")
    reason = recall.reject_reason((n % 9) / 9.0, F.when(n % 4 == 0, 0.0).otherwise(0.5), F.lit(0.4), F.expr(_STATUS), n % 17 == 0, n % 19 == 0, strict=True, contradictions="suppress")
    return fx.read(spark, d, "events").select("event_id", reason.alias("reason"))


@register("n24_temporal_policy", fx.with_("memories") + ", t AS (SELECT id, target, coalesce(CASE WHEN json_valid(metadata) THEN lower(json_extract_string(metadata, '$.memory_type')) END, '') AS k, coalesce(CASE WHEN json_valid(metadata) THEN lower(json_extract_string(metadata, '$.lifecycle')) END, '') AS l FROM memories), c AS (SELECT id, CASE WHEN k IN ('episodic', 'summary') THEN 'episodic' WHEN k = 'tool_trace' OR l = 'scratch' OR target = 'general' THEN 'temporary' WHEN k IN ('factual', 'preference', 'decision', 'project', 'resource') THEN 'durable_fact' ELSE 'default' END AS class FROM t) SELECT id, class, CASE class WHEN 'episodic' THEN 0.8e0 WHEN 'durable_fact' THEN 0.25e0 ELSE 1e0 END AS weight FROM c")
def n24(spark, d):
    kind = F.lower(F.coalesce(policy.json_text("metadata", "$.memory_type"), F.lit("")))
    rows = fx.memories(spark, d).select("id", policy.temporal_class(kind, policy.lifecycle(), F.col("target")).alias("class"))
    return rows.select("id", "class", policy.mapped(F.col("class"), policy.TEMPORAL_WEIGHTS, 1.0).alias("weight"))


_BASE = "(doc_id % 10) / 10e0"


@register("n25_recency_bonus", fx.with_("asked") + f", h AS (SELECT query_id, len(list_intersect(list_distinct({tok('query')}), {listed(intent.FRESHNESS_HINTS)})) AS h, regexp_matches(lower(query), '\\btimezone\\b') AS z FROM asked), w AS (SELECT query_id, CASE WHEN h > 0 THEN least(0.06e0, 0.03e0 + 0.015e0 * h) WHEN z THEN 0.045e0 ELSE 0e0 END AS w FROM h), s AS (SELECT max(doc_id) AS hi, min(doc_id) AS lo FROM documents) SELECT query_id, doc_id, round(CASE WHEN {_BASE} > 0 THEN least(w * (doc_id - lo) / CAST(hi - lo AS DOUBLE) * least(1e0, {_BASE} / 0.6e0), 0.06e0, 0.12e0 * {_BASE}) ELSE 0e0 END, 6) AS bonus FROM documents, w, s WHERE w > 0")
def n25(spark, d):
    docs = fx.read(spark, d, "documents").select("doc_id")
    ends = docs.agg(F.max("doc_id").alias("hi"), F.min("doc_id").alias("lo"))
    asked = fx.asked(spark, d).select("query_id", intent.freshness_weight("query").alias("w")).where("w > 0")
    rows = recall.against(docs.join(F.broadcast(ends)), asked)
    return rows.select("query_id", "doc_id", F.round(intent.recency_bonus(F.expr("(doc_id % 10) / 10.0D"), F.col("w"), (F.col("doc_id") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("bonus"))


@register("n28_current_state_rank", fx.with_("memories", "freshness") + "SELECT m.id, CASE WHEN CAST(m.id AS BIGINT) % 7 IN (0, 1) THEN 0 WHEN CAST(m.id AS BIGINT) % 5 = 0 OR f.status = 'current' THEN 4 WHEN source = 'builtin-curated' AND target IN ('user', 'memory') THEN 3 ELSE 1 END AS rank FROM memories m LEFT JOIN freshness f ON f.id = m.id")
def n28(spark, d):
    n = F.col("id").cast("long")
    rows = fx.memories(spark, d).select("id", "source", "target").join(fx.freshness(spark, d).select("id", "status"), "id", "left")
    return rows.select("id", policy.current_state_rank(n % 7 != 0, n % 7 != 1, n % 5 == 0, F.col("status"), F.col("source"), F.col("target")).alias("rank"))


@register("o1_rank_keys", RECALL + "SELECT query_id, count(*) AS kept, string_agg(id, ',' ORDER BY place) FILTER (place <= 5) AS ids FROM ranked WHERE place IS NOT NULL AND place <= 5 GROUP BY 1")
def o1(spark, d):
    shown = recalled(spark, d).where("place IS NOT NULL")
    return shown.groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]), ",").alias("ids"))


@register("o2_search_plans", "SELECT p_partkey, greatest(1, p_size % 9) AS limit_, greatest(greatest(1, p_size % 9), p_size % 13) AS pool, greatest(greatest(greatest(1, p_size % 9), p_size % 13), p_size % 17) AS vector_k FROM part")
def o2(spark, d):
    n = F.col("p_size")
    return fx.read(spark, d, "part").select("p_partkey", *(c.alias(a) for c, a in zip(recall.search_plan_columns(n % 9, n % 13, n % 17), ("limit_", "pool", "vector_k"))))


@register("o4_two_stage_top", "WITH r AS (SELECT user_id, event_id, CAST(floor(value / 50) AS BIGINT) AS s, ts FROM events), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS n FROM r) SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, ts DESC, event_id) AS rank FROM i WHERE n <= 100) WHERE rank <= 6")
def o4(spark, d):
    rows = fx.read(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.floor(F.col("value") / 50).alias("s"), "ts")
    return recall.two_stage_top(rows, "user_id", 6, F.desc("s"), F.desc("ts"), F.col("id")).select("user_id", F.col("id").alias("event_id"), "rank")


@register("a30_retrieval_metrics", BASE + BM25 + ", labels AS (SELECT query_id, id FROM queries, corpus WHERE contains(content, query)), r AS (SELECT l.query_id, min(rank) AS rank FROM labels l LEFT JOIN (SELECT * FROM best WHERE rank <= 24) b ON b.query_id = l.query_id AND b.id = l.id GROUP BY 1) SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 10 THEN 1e0 ELSE 0e0 END), 6) AS recall, round(avg(CASE WHEN rank = 1 THEN 1e0 ELSE 0e0 END), 6) AS first, round(avg(CASE WHEN rank <= 10 THEN 1e0 / rank ELSE 0e0 END), 6) AS mrr FROM r")
def a30(spark, d):
    corpus, _ = stores(spark, d)
    corpus = corpus.where(policy.ordinary_visible())
    ranked = recall.ranked_by_bm25(corpus, fx.asked(spark, d), 24, recent=True)
    labels = recall.against(corpus.select("id", "content"), fx.queries(spark, d), F.contains(F.col("content"), F.col("query"))).select("query_id", "id")
    return recall.retrieval_metrics(ranked, labels, 10)
