"""Governance: classification, conflicts, merges, lifecycle plans, playbooks and freshness, as plans and pure transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import policy, text
from ..sources.scratch import written
from .scan import ranked

# Words by which a memory is classified and negated, and the levels that a class brings.
PREFERENCE_WORDS = ("prefer", "prefers", "likes", "wants", "希望", "喜欢", "偏好")
OPS_WORDS = ("deploy", "rollout", "restart", "gateway", "command", "production", "prod")
SENSITIVE_WORDS = ("token", "password", "secret", "api key", "apikey")
NEGATION = r"(?i)\b(?:no longer|not|never|不再|不要|不是|取消|avoid|stop)\b"
CLAIM = r"(?i)^\s*(.+?)\s+((?:does\s+not\s+|do\s+not\s+|doesn't\s+|don't\s+|no\s+longer\s+)?(?:is|are|was|were|uses?|prefers?|likes?|wants?))\s+(.+?)\s*[.!?。！？]?\s*$"
CLAIM_STOPWORDS = ("a", "an", "and", "are", "as", "be", "by", "current", "for", "in", "is", "it", "of", "on", "or", "the", "to", "with", "does", "do", "not", "no", "longer", "never")
CONFIDENCE = {"episodic": 0.5, "preference": 0.86, "procedure": 0.8, "project": 0.78, "factual": 0.72}
IMPORTANCE = {"episodic": 0.35, "preference": 0.86, "procedure": 0.82, "project": 0.78, "factual": 0.68}
FEEDBACK = {"success": "success", "failed": "failure", "misleading": "failure", "stale": "stale"}


def any_of(column: Column, words: tuple[str, ...]) -> Column:
    return F.exists(text.words(words), lambda w: F.contains(column, w))


def classify(memories: DataFrame) -> DataFrame:
    """(id, memory_type, confidence, importance, sensitivity): the first class that a row's target or words give."""
    low = F.lower("content")
    kind = (
        F.when(F.col("target") == "general", "episodic")
        .when((F.col("target") == "user") | any_of(low, PREFERENCE_WORDS), "preference")
        .when((F.col("target") == "ops") | any_of(low, OPS_WORDS), "procedure")
        .when(F.col("target") == "project", "project")
        .otherwise("factual")
    )
    rows = memories.select("id", kind.alias("memory_type"), F.when(any_of(low, SENSITIVE_WORDS), "sensitive").otherwise("normal").alias("sensitivity"))
    return rows.withColumn("confidence", policy.mapped(F.col("memory_type"), CONFIDENCE, 0.55)).withColumn("importance", policy.mapped(F.col("memory_type"), IMPORTANCE, 0.55))


def claim_parts(sentence: Column) -> Column:
    """(slot, value): the words before and after the verb of an assertion, without negations; empty if it is none."""
    tokens = lambda c: F.array_except(F.regexp_extract_all(F.lower(c), F.lit(r"[\w-]+"), F.lit(0)), text.words(CLAIM_STOPWORDS))
    verb = F.trim(F.regexp_replace(F.lower(F.regexp_extract(sentence, CLAIM, 2)), NEGATION, " "))
    slot = F.when(verb.isin("is", "are", "was", "were"), F.regexp_extract(sentence, CLAIM, 1)).otherwise(F.concat_ws(" ", F.regexp_extract(sentence, CLAIM, 1), verb))
    return F.struct(tokens(slot).alias("slot"), tokens(F.regexp_replace(F.regexp_extract(sentence, CLAIM, 3), NEGATION, " ")).alias("value"))


def ratio(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def conflicting(a: Column, b: Column) -> Column:
    """Two assertions on one slot and value of which exactly one is negated."""
    alike = text.similarity(text.canonical(text.query_tokens(a)), text.canonical(text.query_tokens(b))) >= 0.35
    x, y = claim_parts(a), claim_parts(b)
    return (text.dedup_key(a) != text.dedup_key(b)) & alike & (a.rlike(NEGATION) != b.rlike(NEGATION)) & (ratio(x["slot"], y["slot"]) >= 0.75) & (ratio(x["value"], y["value"]) >= 0.6)


def conflicts(memories: DataFrame, *within: str) -> DataFrame:
    """(a, b): memories of one scope (and ``within``) that assert and deny one thing, a before b.

    Equal texts stand for each other: pairs are between the least ids of texts. Assertions meet denials by a word of the slot,
    of which two conflicting ones share most.
    """
    keys = ["scope_id", *within]
    rows = memories.groupBy(*keys, "dedup_key").agg(F.min("id").alias("id"), F.min_by("content", "id").alias("content")).withColumn("parts", claim_parts(F.col("content"))).where("size(parts.slot) > 0 AND size(parts.value) > 0")
    rows = rows.withColumns({"denies": F.col("content").rlike(NEGATION), "known": text.canonical(text.query_tokens("content"))})
    side = lambda x, denies: rows.where(F.col("denies") == denies).select(*keys, F.explode("parts.slot").alias("word"), F.col("id").alias(x), F.col("parts").alias(f"p{x}"), F.col("known").alias(f"k{x}"))
    pairs = side("x", False).join(side("y", True), [*keys, "word"]).drop("word").dropDuplicates(["x", "y"])
    good = (text.similarity(F.col("kx"), F.col("ky")) >= 0.35) & (ratio(F.col("px.slot"), F.col("py.slot")) >= 0.75) & (ratio(F.col("px.value"), F.col("py.value")) >= 0.6)
    return pairs.where(good).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def merge_is_safe(a: Column, b: Column) -> Column:
    """Exact copies, or one of at least 12 letters within the other."""
    x, y = text.dedup_key(a), text.dedup_key(b)
    inside = (F.least(F.char_length(x), F.char_length(y)) >= 12) & (F.contains(x, y) | F.contains(y, x))
    return (x != "") & (y != "") & ((x == y) | inside)


def safe_merges(memories: DataFrame) -> DataFrame:
    """Pairs (a, b) of one scope and target that merge_is_safe lets merge.

    The inner words of a contained text are words of the other, so that the rarest of them finds its partners by a join. Texts
    of one or two words have no inner word; they are compared with their scope and target, and are few.
    """
    rows = memories.select("id", "scope_id", "target", text.dedup_key("content").alias("key")).where("key <> ''").withColumn("words", F.split("key", " "))
    words = rows.select("id", "scope_id", "target", F.explode(F.array_distinct("words")).alias("word"))
    inner = rows.where(F.size("words") >= 3).select("id", F.explode(F.array_distinct(F.slice("words", 2, F.size("words") - 2))).alias("word"))
    df = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarest = inner.join(df, "word").groupBy("id").agg(F.min(F.struct("df", "word")).alias("r")).select("id", F.col("r.word").alias("word"))
    own = rows.select("id", "scope_id", "target", "key")
    left = own.withColumnsRenamed({"id": "x", "key": "kx"})
    by_word = left.join(rarest.withColumnRenamed("id", "x"), "x").join(words.withColumnRenamed("id", "y"), ["scope_id", "target", "word"]).select("x", "kx", "y")
    short = left.join(rows.where(F.size("words") < 3).select(F.col("id").alias("x")), "x").join(own.select("scope_id", "target", F.col("id").alias("y")), ["scope_id", "target"]).select("x", "kx", "y")
    pairs = by_word.unionByName(short).where("x <> y").join(own.select(F.col("id").alias("y"), F.col("key").alias("ky")), "y")
    return pairs.where(merge_is_safe(F.col("kx"), F.col("ky"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


#: Where a merged text is divided, and the letters from which a piece contained in another is no piece of its own.
SEGMENTS, LEAST_PIECE = r"\s*\n\s*§\s*\n\s*|\s+/\s+", 12


def pieces(content: Column, origin: Column) -> Column:
    """The segments of a text in order, each with its key, letters and digits alone, and where it comes from."""
    parts = F.transform(F.split(F.coalesce(content, F.lit("")), SEGMENTS), lambda p: F.trim(p))
    rows = F.transform(parts, lambda p: F.struct(p.alias("text"), F.regexp_replace(F.lower(p), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "").alias("key"), F.array(origin).alias("origins")))
    return F.filter(rows, lambda r: r["key"] != "")


def survivors(rows: Column) -> Column:
    """The pieces that stay of an array of them, each with all origins that it stands for.

    In order, a piece falls to the first one kept that equals or contains it, or takes the place of the first one that it
    contains. Only pieces of ``LEAST_PIECE`` letters are looked for in others.
    """
    inside = lambda a, b: (F.char_length(a) >= LEAST_PIECE) & F.contains(b, a)
    falls = lambda x, k: (x["key"] == k["key"]) | inside(x["key"], k["key"])
    none = F.filter(rows, lambda r: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        met = F.array_position(F.transform(kept, lambda k: falls(x, k) | inside(k["key"], x["key"])), True)

        def joined(k: Column) -> Column:
            both = F.array_union(k["origins"], x["origins"])
            return F.when(falls(x, k), F.struct(k["text"].alias("text"), k["key"].alias("key"), both.alias("origins"))).otherwise(F.struct(x["text"].alias("text"), x["key"].alias("key"), both.alias("origins")))

        placed = F.transform(kept, lambda k, i: F.when(i + 1 == met, joined(k)).otherwise(k))
        return F.when(met > 0, placed).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(rows, none, step)


def merged_texts(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, content, segments, origins) of every pair: the text that a reviewed merge of b into a would have.

    Segments keep their order, a's first; repeated and contained ones are left out; ``origins`` lists for each which of the
    two said it. Nothing is paraphrased.
    """
    text_of = lambda x: memories.select(F.col("id").alias(x), F.col("content").alias(f"{x}_content"))
    rows = pairs.select("a", "b").join(text_of("a"), "a").join(text_of("b"), "b")
    kept = rows.select("a", "b", survivors(F.concat(pieces(F.col("a_content"), F.col("a")), pieces(F.col("b_content"), F.col("b")))).alias("kept"))
    return kept.select("a", "b", F.array_join(F.transform("kept", lambda k: k["text"]), "\n§\n").alias("content"), F.size("kept").alias("segments"), F.transform("kept", lambda k: F.array_sort(k["origins"])).alias("origins"))


def transition(memories: DataFrame, plan: DataFrame) -> DataFrame:
    """Apply a plan (id, next, expected): new lifecycle where the expected one still stands; (…, outcome).

    A row that has it already is a no-op, and one that has changed since is a conflict; both stay as they are.
    """
    state = policy.lifecycle()
    rows = memories.join(plan, "id", "left")
    outcome = F.when(F.col("next").isNull(), "kept").when(state == F.col("next"), "noop").when(state == F.col("expected"), "applied").otherwise("conflict")
    rows = rows.withColumn("outcome", outcome)
    return rows.withColumn("lifecycle", F.when(F.col("outcome") == "applied", F.col("next")).otherwise(state)).drop("next", "expected")


def rollback(now: DataFrame, audit: DataFrame, batch: str) -> DataFrame:
    """(id, restored): rows still archived by a batch get the state that its audit rows keep."""
    mine = audit.where(F.col("batch_id") == batch).select("id", "before")
    return now.join(mine, "id").where("lifecycle = 'archived'").select("id", F.col("before").alias("restored"))


def found_in(terms: Column, field: str) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(F.col(field)), t)))


def playbook_score(book: DataFrame, query: str, fields: dict[str, float]) -> Column:
    """Weighted count of query words found in each field."""
    terms = F.filter(F.split(F.regexp_replace(F.lower(F.lit(query)), "[-_]", " "), r"\s+"), lambda t: F.char_length(t) >= 2)
    total = F.lit(0.0)
    for name, weight in fields.items():
        total = total + weight * found_in(terms, name)
    return total


def playbook_confidence(base: Column, success: Column, failure: Column, stale: Column, promoted: Column) -> Column:
    value = 0.65 * base + 0.30 * (success + 1) / (success + failure + 2) + F.when(promoted, 0.05).otherwise(0.0)
    value = value - F.least(F.lit(0.20), 0.05 * stale) - F.when((failure > 0) & (failure >= success), 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.95), value))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """(playbook, success, failure, stale) from outcomes; partial and unknown ones count nothing."""
    kind = policy.mapped(F.col("outcome"), FEEDBACK, "none")
    return feedback.groupBy("playbook").agg(*(F.count_if(kind == k).alias(k) for k in ("success", "failure", "stale")))


def freshness_plan(memories: DataFrame, checked_at: str) -> DataFrame:
    """(id, status, ttl_days, valid_until): what a memory type's policy says, counted from a check."""
    kind = F.coalesce(policy.json_text("metadata", "$.memory_type"), F.lit(""))
    ttl = policy.mapped(kind, policy.TTL_DAYS, 30)
    status = F.when(kind.isin("preference", "procedure", "workflow", "tool_trace", "pitfall", "decision", "episodic", "resource", "constraint"), "current").otherwise("needs_live_check")
    rows = memories.select("id", status.alias("status"), ttl.alias("ttl_days"))
    until = F.when((F.col("status") == "current") & (F.col("ttl_days") > 0), F.lit(checked_at).cast("timestamp") + F.make_dt_interval(F.col("ttl_days")))
    return rows.withColumn("valid_until", until)


def evolution_decision(proposals: DataFrame) -> DataFrame:
    """(proposal, decision) from action, confidence, direct and corroborating sources: allow, review or reject."""
    floor = F.when(F.col("action").isin("add", "enrich"), 0.65).otherwise(0.80)
    backed = (F.col("direct") >= 1) | (F.col("corroborating") >= 2)
    risky = F.col("action").isin("supersede", "retract")
    return proposals.withColumn("decision", F.when(~backed, "reject").when(F.col("confidence") < floor, "review").when(risky & (F.col("direct") < 1), "review").otherwise("allow"))


def claimable(outbox: DataFrame, now: str, lease_seconds: int, limit: int) -> DataFrame:
    """What a worker would take next: pending events and expired claims that are due, oldest first."""
    at = F.lit(now).cast("timestamp")
    expired = (F.col("status") == "claimed") & (F.col("updated_at") + F.make_dt_interval(secs=F.lit(lease_seconds)) <= at)
    due = ((F.col("status") == "pending") | expired) & (F.col("available_at") <= at)
    return outbox.where(due).orderBy("available_at", "id").limit(limit)


def after_failure(outbox: DataFrame, failed: DataFrame, most_attempts: int) -> DataFrame:
    """Statuses after failures: one more attempt, and dead once they are used up."""
    rows = outbox.join(failed.select("id", F.lit(True).alias("failed")), "id", "left")
    n = F.col("attempts") + F.coalesce(F.col("failed").cast("int"), F.lit(0))
    status = F.when(F.col("failed") & (n >= most_attempts), "dead").when(F.col("failed"), "pending").otherwise(F.col("status"))
    return rows.withColumns({"attempts": n, "status": status}).drop("failed")


def connected_in_group(pairs: DataFrame) -> DataFrame:
    """(id, head): the smallest id that pairs (a, b) connect each id with.

    Heads spread to neighbours and jump to their heads' heads until none changes, so that paths double each round. Each round
    is written to the shared folder.
    """
    edges = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    heads = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("head")))
    while True:
        near = edges.join(heads.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("head").alias("near"))
        now = heads.join(near, "id").select("id", F.least("head", "near").alias("new"), F.col("head").alias("old"))
        jump = now.select(F.col("id").alias("new"), F.col("new").alias("up"))
        now = written(now.join(jump, "new", "left").select("id", F.coalesce(F.least("new", "up"), "new").alias("head"), "old"))
        heads = now.drop("old")
        if now.where("head <> old").isEmpty():
            return heads


def keep_newest(rows: DataFrame, group: str, keep: int, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


#: Steps of feedback that one task folds at a time.
TRUST_BLOCK = 10_000


def trust(feedback: DataFrame, key: str, order: list[str], start: float = 0.5) -> DataFrame:
    """(key, trust) after feedback with a column step: each step in order, held between 0 and 1.

    A run of held steps is again one held step: x to min(high, max(low, x + sum)). So the steps of a key are folded in blocks of
    ``TRUST_BLOCK``, by their ranks, and then the blocks: a hot key is ranked, dealt and folded by many tasks.
    """
    fold = lambda steps: F.aggregate(
        steps, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high")),
        lambda s, x: F.struct((s["sum"] + x["sum"]).alias("sum"), F.least(x["high"], F.greatest(x["low"], s["low"] + x["sum"])).alias("low"), F.least(x["high"], F.greatest(x["low"], s["high"] + x["sum"])).alias("high")),
    )
    one = F.struct(F.col("step").cast("double").alias("sum"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    placed = ranked(feedback.select(key, *order, one.alias("s")), [key], [F.col(c) for c in order], "place")
    blocks = placed.groupBy(key, F.floor(F.col("place") / TRUST_BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "s"))).alias("steps"))
    blocks = blocks.select(key, "block", fold(F.transform("steps", lambda x: x["s"])).alias("s"))
    whole = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "s"))).alias("blocks")).select(key, fold(F.transform("blocks", lambda x: x["s"])).alias("s"))
    return whole.select(key, F.least(F.col("s.high"), F.greatest(F.col("s.low"), F.lit(start) + F.col("s.sum"))).alias("trust"))


def reviewed(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, outcome) of review requests (id, action, replacement, expected_at).

    Only candidates are reviewed, and only as they were seen; a supersession needs a visible replacement.
    """
    shown = memories.where(policy.ordinary_visible()).select(F.col("id").alias("replacement")).withColumn("shown", F.lit(True))
    rows = requests.join(memories.select("id", policy.lifecycle().alias("state"), "updated_at"), "id", "left").join(shown, "replacement", "left")
    outcome = (
        F.when(F.col("state").isNull(), "not_found").when(F.col("state") != "candidate", "invalid_state").when(F.col("updated_at") != F.col("expected_at"), "conflict")
        .when(F.col("action") == "promote", "promoted").when(F.col("action") == "archive", "archived")
        .when((F.col("action") == "supersede") & F.col("shown").isNotNull(), "superseded").when(F.col("action") == "supersede", "replacement_not_visible").otherwise("unknown_action")
    )
    return rows.select("id", outcome.alias("outcome"))


def new_versions(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """The version rows that changes (playbook, change_id, change_type) add behind those there are, in the order of change_id."""
    last = versions.groupBy("playbook").agg(F.max("version").alias("last"))
    w = W.partitionBy("playbook").orderBy("change_id")
    rows = changes.join(last, "playbook", "left").withColumn("version", F.coalesce("last", F.lit(0)) + F.row_number().over(w))
    return rows.select("playbook", F.col("version").cast("long").alias("version"), "change_type")


def packets(events: DataFrame, least: int = 16, most: int = 4000) -> DataFrame:
    """(id, content, refused): sanitised evidence of events (id, kind, content), and why an event is none."""
    clean = F.rtrim(F.left(text.sanitized("content"), F.lit(most)))
    known = F.col("kind").isin("user_correction", "task_closeout", "pre_compress", "session_end", "release_closeout", "issue_closeout")
    refused = F.array_compact(F.array(F.when(~known, "unknown_event_kind"), F.when(F.col("content").rlike(text.SECRET), "plaintext_secret_rejected"), F.when(F.char_length(clean) < least, "low_signal")))
    return events.select("id", clean.alias("content"), refused.alias("refused"))


# What marks a release step, small talk, a preference, operations and a project in an event.
EPHEMERAL = r"(?i)\bissue\s*#?\d+\b|\bcommit\s+[0-9a-f]{7,40}\b|\b[0-9a-f]{7,40}\b|\b\d+\s+tests?\s+passed\b|\b\d+\s+passed\b|\bPR\s*#?\d+\b|\btag\s+v?\d+\.\d+\.\d+\b"
LOW_VALUE = r"(?i)\btoday\b|\btemporary\b|\bcurrent task\b|\bthis session\b|\bstatus update\b|临时|当前任务|本轮|今天|状态更新"
USER_WISH = r"(?i)\buser\s+prefers?\b|\buser\s+wants?\b|用户(?:偏好|希望|要求|喜欢)|以后|不要再|always|prefer"
OPERATIONS = r"(?i)systemd|service|port|host|gateway|rollback|backup|部署|服务|端口|回滚|备份"
PROJECTS = r"(?i)project|repo|repository|plugin|package|release gate|项目|仓库|插件"


def event_candidates(found: DataFrame) -> DataFrame:
    """(id, target, memory_type, confidence, content) of the packets that make a candidate; one for each content."""
    c = F.col("content")
    good = found.where(F.size("refused") == 0).where(~c.rlike(EPHEMERAL) & (~c.rlike(LOW_VALUE) | c.rlike(USER_WISH)))
    of = lambda target, kind, sure: F.struct(F.lit(target).alias("target"), F.lit(kind).alias("memory_type"), F.lit(sure).alias("confidence"))
    kind = F.when(c.rlike(USER_WISH), of("user", "preference", 0.78)).when(c.rlike(OPERATIONS), of("ops", "workflow", 0.68)).when(c.rlike(PROJECTS), of("project", "factual", 0.66))
    rows = good.withColumn("kind", kind).where("kind IS NOT NULL").select("id", "kind.*", "content")
    return rows.groupBy("target", text.dedup_key("content").alias("key")).agg(F.min_by(F.struct("id", "memory_type", "confidence", "content"), "id").alias("r")).select("r.id", "target", "r.memory_type", "r.confidence", "r.content")


def stored(state: DataFrame, batch: DataFrame, at: str) -> DataFrame:
    """The state after storing a batch: new rows come, and a visible row that one of them repeats is touched at ``at``.

    Of rows of the batch alike in scope, target and key the first by id counts.
    """
    key = ["scope_id", "target", "dedup_key"]
    first = batch.groupBy(*key).agg(F.min_by(F.struct(*(c for c in batch.columns if c not in key)), "id").alias("r")).select(*key, "r.*")
    seen = first.select(*key).withColumn("again", F.lit(True))
    touched = state.join(seen, key, "left").withColumn("updated_at", F.when(F.col("again") & policy.ordinary_visible(), F.lit(at).cast(state.schema["updated_at"].dataType)).otherwise(F.col("updated_at"))).drop("again")
    new = first.join(state.where(policy.ordinary_visible()).select(*key), key, "left_anti")
    return touched.unionByName(new.select(*state.columns))


def replayable(entries: DataFrame, rejections: DataFrame, lineage: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """(entry_id, reason) of processed entries without lineage whose last rejection in their own run has such a reason."""
    last = rejections.groupBy("entry_id", "run_id").agg(F.max_by("reason", F.struct("at", "reason")).alias("reason"))
    rows = entries.where("run_id IS NOT NULL").join(last, ["entry_id", "run_id"]).join(lineage.select("entry_id").distinct(), "entry_id", "left_anti")
    like = F.lit(False)
    for p in prefixes:
        like = like | F.col("reason").startswith(p)
    return rows.where(like).select("entry_id", "reason")


def grounded(claims: DataFrame, evidence: DataFrame, least: float = 0.6) -> DataFrame:
    """(claim_id, share, grounded): the best share of a sentence's words in one of the pieces of evidence that it cites.

    ``claims`` are (claim_id, sentence, cited: array of ids), ``evidence`` (evidence_id, content).
    """
    cited = claims.select("claim_id", text.semantic_tokens("sentence").alias("asked"), F.explode_outer("cited").alias("evidence_id"))
    rows = cited.join(evidence.select("evidence_id", text.normalized(text.query_tokens("content")).alias("known")), "evidence_id", "left")
    share = F.when(F.col("known").isNull() | (F.size("asked") == 0), 0.0).otherwise(text.overlap_share(F.col("asked"), F.col("known")))
    best = rows.groupBy("claim_id").agg(F.max(share).alias("share"))
    return best.withColumn("grounded", F.col("share") >= least)


def synthesis(entries: DataFrame, most: int = 8) -> DataFrame:
    """(session_id, anchors, tools, verified): what of a session may anchor a playbook.

    Anchors are the first ``most`` user turns and the turns with a check or a repository state, told apart by kind and text.
    """
    t = F.col("content")
    kind = F.when(F.col("role") == "user", "user_statement").when(t.rlike(r"(?i)\b(?:pytest|ruff|pyright)\b"), "test_command").when(t.rlike(r"(?i)\b(?:doctor|health check|release gate|smoke)\b"), "health_report").when(t.rlike(r"(?i)\b(?:git\s+status|git\s+diff|pull request|PR|issue\s*#?\d+)\b"), "repo_state").when((F.col("role") == "assistant") & t.rlike("(?i)完成|通过|success|fixed|done|passed"), "assistant_closure")
    rows = entries.where(F.col("role").isin("user", "assistant", "tool")).withColumn("kind", kind).where("kind IS NOT NULL")
    first = rows.groupBy("session_id", "kind", F.left(text.sanitized("content"), F.lit(260)).alias("said")).agg(F.min("turn_number").alias("turn"))
    first = first.withColumn("n", F.row_number().over(W.partitionBy("session_id").orderBy("turn", "kind", "said"))).where(F.col("n") <= most)
    return first.groupBy("session_id").agg(F.count(F.lit(1)).alias("anchors"), F.count_if(F.col("kind") == "user_statement").alias("stated"), F.bool_or(F.col("kind").isin("test_command", "health_report")).alias("verified"))


def updated(state: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """The state with new contents: changes are (id, content); summary, key, time and row follow the content."""
    rows = state.join(changes.select("id", F.col("content").alias("_new")), "id", "left")
    new, changed = F.coalesce("_new", "content"), F.col("_new").isNotNull()
    put = {"content": new, "summary": F.when(changed, F.left("_new", F.lit(220))).otherwise(F.col("summary")), "dedup_key": F.when(changed, text.dedup_key("_new")).otherwise(F.col("dedup_key"))}
    put["updated_at"] = F.when(changed, F.lit(at).cast(state.schema["updated_at"].dataType)).otherwise(F.col("updated_at"))
    return rows.withColumns(put).select(*state.columns)


def companions(old: DataFrame, changed: DataFrame, fresh: DataFrame, key: str = "memory_id") -> DataFrame:
    """A companion table after an update: rows of changed ids go, and those made anew from the changed rows come."""
    return old.join(changed.select(F.col("id").alias(key)), key, "left_anti").unionByName(fresh.join(changed.select(F.col("id").alias(key)), key, "left_semi"))


def activated(manifest: DataFrame, generation: str, expected: str) -> DataFrame:
    """The manifest (generation_id, status, previous, outcome) after an activation, or as it was if the expectation fails.

    A ready generation becomes active and keeps the one before it as ``previous``, if that one is what the caller expects.
    """
    ok = manifest.agg((F.count_if((F.col("status") == "active") & (F.col("generation_id") == expected)) * F.count_if((F.col("status") == "ready") & (F.col("generation_id") == generation)) == 1).alias("ok"))
    rows = manifest.drop("outcome").join(F.broadcast(ok))  # one row
    mine, was = F.col("ok") & (F.col("generation_id") == generation), F.col("ok") & (F.col("generation_id") == expected)
    return rows.select("generation_id", F.when(mine, "active").when(was, "retired").otherwise(F.col("status")).alias("status"), F.when(mine, expected).otherwise(F.col("previous")).alias("previous"), F.when(F.col("ok"), "applied").otherwise("conflict").alias("outcome"))


def rolled_back(manifest: DataFrame, expected: str) -> DataFrame:
    """The manifest after the active generation gave way to its predecessor, if it is the expected one and has one."""
    now = manifest.where((F.col("status") == "active") & (F.col("generation_id") == expected)).select(F.col("generation_id").alias("_from"), F.col("previous").alias("_to")).where("_to IS NOT NULL")
    rows = manifest.drop("outcome").join(F.broadcast(now), F.lit(True), "left")  # at most one row
    back = F.col("_to").isNotNull()
    status = F.when(back & (F.col("generation_id") == F.col("_from")), "ready").when(back & (F.col("generation_id") == F.col("_to")), "active").otherwise(F.col("status"))
    return rows.select("generation_id", status.alias("status"), F.when(back & (F.col("generation_id") == F.col("_from")), F.lit(None)).otherwise(F.col("previous")).alias("previous"), F.when(back, "applied").otherwise("conflict").alias("outcome"))
