"""Queries of facts by question and of executed proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts
from . import fixtures as fx
from .recalling import STEM, listed, tok
from ..functions import text
from .registry import register

AT = "2024-01-29 12:00:00"
_MOST, _SIZE, _ROUTES = 40, 6, 5
_ASKED = "SELECT CAST(event_id AS {s}) AS query_id, CASE WHEN event_id % 500 = 0 THEN '' WHEN event_id % 150 = 0 THEN concat('number ', CAST(user_id AS {s})) WHEN event_id % 100 = 0 THEN concat('what did user ', CAST(user_id AS {s}), ' ', event_type, ' or purchase or view and how often did user ', CAST(user_id % 50 + 10 AS {s}), ' click error signup scroll login share comment upload last week') ELSE concat('when did user ', CAST(user_id AS {s}), ' ', event_type, ' ', CAST(event_id % 13 AS {s})) END AS query FROM {t} WHERE event_id % 50 = 0"
_MEM = "memories AS (SELECT id, content, summary FROM memories0)"

_SEARCH = (
    fx.with_("claims", "memories").replace("WITH ", "WITH ", 1)
    + f", asked AS ({_ASKED.format(s='VARCHAR', t='events')}), w0 AS (SELECT query_id, query, list_filter(x, lambda t, i: list_position(x, t) = i AND NOT list_contains({listed((*text.SEMANTIC_STOPWORDS, *text.CJK_STOPWORDS))}, t)) AS ws FROM (SELECT *, {tok('query')} AS x FROM asked)), "
    f"w AS (SELECT *, len(ws) AS n FROM w0), three AS (SELECT query_id, 0 AS route, ws[1:{_SIZE}] AS ts FROM w WHERE n > 0 UNION ALL SELECT query_id, 1, ws[n - {_SIZE - 1}:n] FROM w WHERE n > {_SIZE} UNION ALL SELECT query_id, 2, list_transform(range({_SIZE}), lambda i: ws[CAST(round_even(i * (n - 1) / {_SIZE - 1}e0, 0) AS INTEGER) + 1]) FROM w WHERE n > {_SIZE}), "
    "rest AS (SELECT query_id, list_filter(ws, lambda t: NOT list_contains(seen, t)) AS rs FROM w JOIN (SELECT query_id, flatten(list(ts)) AS seen FROM three GROUP BY 1) USING (query_id)), "
    f"cut AS (SELECT query_id, CAST(3 + k AS INTEGER) AS route, rs[k * {_SIZE} + 1 : k * {_SIZE} + {_SIZE}] AS ts FROM (SELECT *, unnest(range(CAST(ceil(len(rs) / {_SIZE}e0) AS BIGINT))) AS k FROM rest) WHERE 3 + k < {_ROUTES}), "
    "rt AS (SELECT DISTINCT query_id, route, unnest(ts) AS term FROM (SELECT * FROM three UNION ALL SELECT * FROM cut)), "
    f"now AS (SELECT c.*, m.content, m.summary, c.subject_key || ' ' || c.predicate_key || ' ' || c.value AS said FROM claims c JOIN memories m ON m.id = c.memory_id WHERE status = 'current' AND retired_at IS NULL AND (valid_from IS NULL OR valid_from <= TIMESTAMP '{AT}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')), "
    f"toks AS (SELECT claim_id AS id, unnest({tok('said')}) AS term FROM now), dl AS (SELECT id, count(*) AS dl FROM toks GROUP BY id), total AS (SELECT (SELECT count(*) FROM now) AS n, (SELECT count(*) FROM toks) / CAST((SELECT count(*) FROM now) AS DOUBLE) AS avgdl), tf AS (SELECT id, term, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM rt) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "bm AS (SELECT query_id, route, id, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS bm25 FROM tf JOIN df USING (term) JOIN dl USING (id) JOIN rt USING (term), total GROUP BY 1, 2, 3), "
    "best AS (SELECT query_id, route, bm.id, row_number() OVER (PARTITION BY query_id, route ORDER BY round(bm25, 6) DESC, confidence DESC, recorded_at DESC, bm.id) AS rank FROM bm JOIN now ON now.claim_id = bm.id), "
    f"newest AS (SELECT claim_id AS id, row_number() OVER (ORDER BY confidence DESC, recorded_at DESC, claim_id) AS rank FROM now), every AS (SELECT * FROM best WHERE rank <= {_MOST + 1} UNION ALL SELECT query_id, 0, id, rank FROM w, newest WHERE n = 0 AND rank <= {_MOST + 1}), "
    f"turns AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY rank, route) AS turn FROM every), chosen AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, route, id) AS place FROM turns WHERE turn = 1) WHERE place <= {_MOST}), "
    "told AS (SELECT query_id, max(n) AS longest FROM (SELECT query_id, route, count(*) AS n FROM every GROUP BY 1, 2) GROUP BY 1), uni AS (SELECT query_id, count(DISTINCT id) AS u FROM every GROUP BY 1) "
)


def asked(spark, d):
    fx.read(spark, d, "events").createOrReplaceTempView("asked_events")
    return spark.sql(_ASKED.format(s="STRING", t="asked_events"))


def found(spark, d):
    m = fx.memories(spark, d).select("id", "content", "summary")
    return facts.search(fx.claims(spark, d), m, asked(spark, d), AT, 8, _MOST, _SIZE, _ROUTES)


@register("q7_fact_views", _SEARCH + f", u AS (SELECT DISTINCT claim_id, u FROM (SELECT claim_id, unnest([t, {STEM}]) AS u FROM (SELECT claim_id, unnest({tok('hay')}) AS t FROM (SELECT claim_id, lower(said || chr(10) || content || chr(10) || summary) AS hay FROM now WHERE claim_id IN (SELECT id FROM chosen))))), "
    f"z AS (SELECT query_id, query, t, {STEM} AS st, least(8, greatest(2, length(t))) AS weight FROM (SELECT query_id, query, unnest(ws) AS t FROM w)), "
    "s AS (SELECT c.query_id, c.id, any_value(now.confidence) AS confidence, any_value(now.scope_id) AS scope_id, any_value(now.subject_key) AS subject_key, any_value(now.predicate_key) AS predicate_key, "
    "round(CASE WHEN any_value(w.query) = '' OR bool_or(contains(lower(said || chr(10) || content || chr(10) || summary), lower(w.query))) THEN 1e0 ELSE sum(CASE WHEN contains(lower(said || chr(10) || content || chr(10) || summary), z.t) OR u.u IS NOT NULL THEN weight ELSE 0 END) / CAST(sum(weight) AS DOUBLE) END, 6) AS score "
    "FROM chosen c JOIN w USING (query_id) JOIN now ON now.claim_id = c.id LEFT JOIN z ON z.query_id = c.query_id LEFT JOIN u ON u.claim_id = c.id AND u.u = z.st GROUP BY 1, 2) "
    "SELECT query_id, id AS claim_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, confidence DESC, scope_id, subject_key, predicate_key, id) AS place FROM s WHERE score > 0) WHERE place <= 8")
def q7v(spark, d):
    return found(spark, d)[0]


@register("o9_fact_overflow", _SEARCH + f"SELECT w.query_id, CAST(coalesce(r.routes, 0) AS INTEGER) AS routes, least(coalesce(u, 0), {_MOST}) AS candidates, CAST(coalesce(r.covered, 0) AS INTEGER) AS covered, CAST(w.n AS INTEGER) AS words, coalesce(u > {_MOST} OR longest > {_MOST}, false) AS truncated, NOT coalesce(u > {_MOST} OR longest > {_MOST}, false) AND coalesce(r.covered, 0) = w.n AS complete FROM w LEFT JOIN told USING (query_id) LEFT JOIN uni USING (query_id) LEFT JOIN (SELECT query_id, count(DISTINCT route) AS routes, count(DISTINCT term) AS covered FROM rt GROUP BY 1) r USING (query_id)")
def o9f(spark, d):
    return found(spark, d)[1]


#: Proposals: most aim at what the one before them in their slot makes, others at the slot's claim of the ledger.
_PROPOSALS = (
    "SELECT concat('a', CAST(event_id AS {s})) AS action_id, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'retract' WHEN 1 THEN 'enrich' WHEN 2 THEN 'add' ELSE 'supersede' END AS action, CASE event_id % 23 WHEN 0 THEN 'preview' WHEN 1 THEN 'auto_apply' ELSE 'reviewed_apply' END AS mode, "
    "scope_id, subject_key, predicate_key, CASE event_id % 2 WHEN 0 THEN 'single' ELSE 'multi' END AS cardinality, CAST(event_id % 13 AS {s}) AS value, CASE WHEN event_id % 19 <> 0 THEN ts END AS valid_from, 0.4E0 + (event_id % 60) / 1E2 AS confidence, "
    "CASE WHEN event_id % 5 = 0 OR before IS NULL THEN own ELSE concat('claim:a', CAST(before AS {s})) END AS target_id, CASE WHEN event_id % 5 = 0 OR before IS NULL THEN CASE WHEN event_id % 11 = 0 THEN ts ELSE own_at END END AS expected_at FROM "
    "(SELECT e.*, lag(event_id) OVER (PARTITION BY e.scope_id, e.subject_key, e.predicate_key ORDER BY event_id) AS before, o.claim_id AS own, o.recorded_at AS own_at FROM (SELECT *, concat('scope-', CAST(user_id % 7 AS {s})) AS scope_id, concat('user:', CAST(user_id AS {s})) AS subject_key, event_type AS predicate_key FROM {e}) e "
    "LEFT JOIN (SELECT scope_id, subject_key, predicate_key, max(claim_id) AS claim_id, max_by(recorded_at, claim_id) AS recorded_at FROM {c} WHERE status = 'current' AND retired_at IS NULL GROUP BY 1, 2, 3) o ON o.scope_id = e.scope_id AND o.subject_key = e.subject_key AND o.predicate_key = e.predicate_key)"
)


def proposals(spark, d):
    fx.read(spark, d, "events").createOrReplaceTempView("proposed_events")
    fx.claims(spark, d).createOrReplaceTempView("proposed_claims")
    return spark.sql(_PROPOSALS.format(s="STRING", e="proposed_events", c="proposed_claims"))


_WHY = "CASE WHEN mode = 'preview' THEN 'preview' WHEN scope_id = 'scope-3' THEN 'scope_not_writable' WHEN confidence < 0.5 THEN 'low_confidence' WHEN action = 'supersede' AND cardinality = 'single' AND valid_from IS NULL THEN 'missing_boundary' WHEN mode = 'auto_apply' AND action IN ('supersede', 'retract') THEN 'review_required' WHEN action <> 'add' AND target_id IS NULL THEN 'missing_target' END"
_PLAN = (
    fx.with_("claims").replace("WITH ", "WITH RECURSIVE ", 1) + f", p0 AS ({_PROPOSALS.format(s='VARCHAR', e='events', c='claims')}), p AS (SELECT *, {_WHY} AS early, CASE WHEN action IN ('add', 'supersede') THEN 'claim:' || action_id END AS new_claim_id FROM p0), known AS (SELECT claim_id AS target_id, recorded_at FROM claims WHERE status = 'current' AND retired_at IS NULL), "
    "made AS (SELECT new_claim_id AS target_id, seq AS made_at, action_id AS maker FROM p WHERE early IS NULL AND new_claim_id IS NOT NULL), "
    "tied AS (SELECT p.*, k.recorded_at IS NOT NULL AS old, maker, CASE WHEN action = 'add' THEN NULL WHEN k.recorded_at IS NULL AND NOT coalesce(made_at < seq, false) THEN 'target_not_found' WHEN k.recorded_at IS NOT NULL AND expected_at IS DISTINCT FROM k.recorded_at THEN 'version_conflict' WHEN k.recorded_at IS NULL AND expected_at IS NOT NULL THEN 'version_conflict' END AS wrong FROM p LEFT JOIN known k ON k.target_id = p.target_id LEFT JOIN made m ON m.target_id = p.target_id WHERE early IS NULL), "
    "win AS (SELECT target_id, min(seq) AS ended_at, min_by(action_id, seq) AS winner FROM tied WHERE wrong IS NULL AND action IN ('supersede', 'retract') GROUP BY 1), "
    "node AS (SELECT t.*, w.winner, w.ended_at, wrong IS NOT NULL OR (action IN ('supersede', 'retract') AND winner <> action_id) AS dead FROM tied t LEFT JOIN win w USING (target_id)), "
    "live AS (SELECT action_id FROM node WHERE NOT dead AND (action = 'add' OR old) UNION ALL SELECT n.action_id FROM live l JOIN node n ON n.maker = l.action_id AND NOT n.dead AND NOT n.old AND n.action <> 'add'), "
    "fin AS (SELECT n.action_id, CASE WHEN wrong IS NOT NULL THEN wrong WHEN action IN ('supersede', 'retract') THEN CASE WHEN l.action_id IS NOT NULL THEN 'applied' WHEN dead AND w.action_id IS NOT NULL AND ended_at < seq THEN 'superseded_before' ELSE 'target_not_applied' END WHEN action = 'enrich' THEN CASE WHEN l.action_id IS NULL THEN 'target_not_applied' WHEN w.action_id IS NOT NULL AND ended_at < seq THEN 'superseded_before' ELSE 'applied' END ELSE 'applied' END AS late FROM node n LEFT JOIN live l ON l.action_id = n.action_id LEFT JOIN live w ON w.action_id = n.winner), "
    "plan AS (SELECT p.*, coalesce(early, late) AS outcome FROM p LEFT JOIN fin USING (action_id)) "
)


def plan(spark, d):
    c = fx.claims(spark, d)
    scopes = c.select("scope_id").distinct().where("scope_id <> 'scope-3'")
    return c, facts.planned(c, proposals(spark, d), scopes)


@register("q25_executed_receipts", _PLAN + "SELECT action_id, seq, outcome, CASE WHEN outcome = 'applied' AND action IN ('supersede', 'retract') THEN target_id END AS closed_claim_id, CASE WHEN outcome = 'applied' THEN new_claim_id END AS new_claim_id, CASE WHEN outcome = 'applied' AND action = 'supersede' THEN 'supersedes' END AS relation FROM plan")
def q25r(spark, d):
    c, p = plan(spark, d)
    return facts.executed(c, p, "2024-03-01 00:00:00")[1]


@register("q25_executed_ledger", _PLAN + ", ends AS (SELECT target_id, action, valid_from, new_claim_id FROM plan WHERE outcome = 'applied' AND action IN ('supersede', 'retract')), l AS (SELECT claim_id, status, retired_at, valid_to FROM claims UNION ALL SELECT new_claim_id, 'current', NULL, NULL FROM plan WHERE outcome = 'applied' AND new_claim_id IS NOT NULL) "
    "SELECT claim_id, CASE WHEN e.target_id IS NULL THEN status WHEN e.action = 'supersede' THEN 'superseded' ELSE 'retracted' END AS status, CASE WHEN e.action = 'supersede' THEN e.new_claim_id END AS superseded_by, strftime(CASE WHEN e.target_id IS NULL THEN l.valid_to WHEN e.action = 'supersede' THEN coalesce(e.valid_from, TIMESTAMP '2024-03-01 00:00:00') ELSE TIMESTAMP '2024-03-01 00:00:00' END, '%Y-%m-%d %H:%M:%S') AS ends FROM l LEFT JOIN ends e ON e.target_id = l.claim_id")
def q25l(spark, d):
    c, p = plan(spark, d)
    ledger, _ = facts.executed(c, p, "2024-03-01 00:00:00")
    return ledger.select("claim_id", "status", "superseded_by", F.date_format("valid_to", "yyyy-MM-dd HH:mm:ss").alias("ends"))
