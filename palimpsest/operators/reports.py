"""Reports: duplicates, hygiene, forgetting, quality, integrity and queues, each as one grouped pass where it can be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence, policy, text
from .scan import ranked

# Openings and markers of rows that hygiene, cleanup and quality rules look for.
WRAPPER_NOISE = r"(?i)^\[Recent Telegram chat history|^\[CONTEXT COMPACTION|^\[System note:|^## Active Task|^## Remaining Work|reply with ok and nothing else|^\s*you are an ai assistant"
ROLE_PREFIX = {"transcript.role-prefix-user": r"(?:^|[\s。；;])user:\s*", "transcript.role-prefix-assistant": r"(?:^|[\s。；;])assistant:\s*"}
TEMPLATE_PREFIX = {"template.operations-workflow-summary": "operations workflow summary", "template.journal-digest-memory": "journal digest memory"}
TRANSCRIPT_MARKERS = ("tool execution trace", "python -m pytest", "pytest ", "git status", "ruff check", "pyright", "traceback", "stdout", "stderr")
STALE_TERMS = ("当前系统现状", "当前技术现状", "当前系统状态", "当前状态", "技术债务", "current status", "current state", "technical debt")
TEMPLATE_OPENINGS = ("Journal digest memory", "Operations workflow summary")
ATTACHMENT_MARKERS = ("media:", "[attachment", "attachment://", "sandbox:/mnt/data/")
CACHE_PATHS = ("/tmp/", "image_cache/", "audio_cache/", "\\appdata\\local\\temp", "/appdata/local/temp", "%temp%", "%tmp%", "\\windows\\temp", "/windows/temp")
STALE_REVIEW = ("stale-review", "stale_review", "stale review")
DIGEST_SOURCES = ("journal-digest", "nightly-digest")
SECRET_REFERENCES = ("secret_reference", "secret-index", "secret_index", "external-vault-reference", "external_vault_reference")
# What a person has to look at, old progress, and memory types that last or pass.
REVIEW_TERMS = ("password", "token", "secret", "api key", "api_id", "api_hash", "credential", "private key", "密钥", "密码", "凭据", "删除", "重启", "发布", "推送", "提交", "commit", "push", "tag", "release", "sudo", "systemctl")
PROGRESS_TERMS = ("commit `", "commit ", "pull request", "pr #", "issue #", "run `", "pid ", "已推送", "已发布", "工作树", "当前仍为")
STABLE_TYPES = ("factual", "preference", "procedure", "workflow", "pitfall", "decision", "constraint", "project", "resource")
NOISE_TYPES = ("summary", "episodic", "tool_trace")
PROFILE_TARGETS = ("user", "memory", "project", "ops")
VERY_SHORT, VERY_LONG = 24, 2400


def duplicate_groups(corpus: DataFrame, key: list[str], newest_first: bool = True) -> DataFrame:
    """Groups of rows alike in ``key``: how many, which stays, which go.

    The ids that go are listed only as a count and a bounded sample; the full list is ``duplicates``, a row each.
    """
    rows = duplicates(corpus, key, newest_first)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("place") == 1, F.col("id"))).alias("keep_id"), F.sort_array(F.collect_set(F.when(F.col("place").between(2, 6), F.col("id")))).alias("sample"))


def duplicates(corpus: DataFrame, key: list[str], newest_first: bool = True) -> DataFrame:
    """Every row of a group of two or more, with its place: 1 stays."""
    counts = corpus.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    order = [F.desc("updated_at"), F.desc("created_at"), F.desc("id")] if newest_first else [F.col("created_at"), F.col("id")]
    return ranked(corpus.join(counts, key), key, order, "place")


def noise_reason(content: str = "content") -> Column:
    """Why a row is cleanup noise; null if it is not."""
    low = F.lower(F.ltrim(content))
    out = F.lit(None).cast("string")
    for reason, pattern in reversed(ROLE_PREFIX.items()):
        out = F.when(low.rlike(pattern), reason).otherwise(out)
    for reason, opening in reversed(TEMPLATE_PREFIX.items()):
        out = F.when(low.startswith(opening), reason).otherwise(out)
    return out


def hygiene(corpus: DataFrame) -> DataFrame:
    """One row for each target: all rows and those that are noise, assistant scratch, very short or very long."""
    n = F.char_length(F.trim("content"))
    return corpus.groupBy("target").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("content").rlike(WRAPPER_NOISE)).alias("noise"),
        F.count_if((F.col("target") == "general") & (F.col("source") == "turn-assistant")).alias("assistant"),
        F.count_if(n <= VERY_SHORT).alias("very_short"),
        F.count_if(F.char_length("content") >= VERY_LONG).alias("very_long"),
    )


def forgetting(corpus: DataFrame) -> DataFrame:
    """(id, action, reason) of rows to forget: hard, soft or review. The first reason that holds is given.

    Duplicates keep their oldest row and come last; archived rows are left alone.
    """
    live = corpus.where(policy.lifecycle() != "archived")
    key, state = ["scope_id", "target", "dedup_key"], policy.lifecycle()
    first = live.where("dedup_key <> ''").groupBy(*key).agg(F.min(F.struct("created_at", "id")).alias("first"))
    rows = live.join(first, key, "left").withColumn("copy", F.coalesce(F.struct("created_at", "id") != F.col("first"), F.lit(False)))
    reason = (
        F.when(F.col("content").rlike(text.SECRET), "secret-like-content")
        .when(F.col("content").rlike(WRAPPER_NOISE), "runtime-wrapper-noise")
        .when((F.col("target") == "general") & (F.col("source") == "turn-assistant"), "assistant-prose-scratch")
        .when(F.char_length(F.trim("content")) <= VERY_SHORT, "very-short-low-value")
        .when(F.col("copy"), "duplicate-memory")
        .when(state == "candidate", "candidate-review-debt")
    )
    action = policy.mapped(F.col("reason"), {"secret-like-content": "hard", "runtime-wrapper-noise": "hard", "candidate-review-debt": "review"}, "soft")
    return rows.select("id", reason.alias("reason")).where("reason IS NOT NULL").withColumn("action", action)


def _has(low: Column, words: tuple[str, ...]) -> Column:
    return F.exists(text.words(words), lambda w: F.contains(low, w))


def _meta(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(policy.json_text("metadata", f"$.{name}"), F.lit(""))))


def lint_rules() -> Column:
    """Every rule that an active row breaks, by name."""
    both = F.concat_ws("\n", "summary", "content")
    low = F.lower(both)
    marks = F.size(F.filter(text.words(TRANSCRIPT_MARKERS), lambda m: F.contains(F.lower("content"), m)))
    n = F.char_length("content")
    opening = F.lit(False)
    for words in TEMPLATE_OPENINGS:
        opening = opening | F.col("content").startswith(words) | F.col("summary").startswith(words)
    stale = _meta("expires_at").isin(*STALE_REVIEW) | _meta("freshness").isin(*STALE_REVIEW) | _meta("review_status").isin(*STALE_REVIEW)
    return F.array_compact(
        F.array(
            F.when(opening, "template_prefix"),
            F.when(_has(low, ATTACHMENT_MARKERS), "raw_attachment_marker"),
            F.when(F.contains(low, F.lit("artifact anchors:")), "artifact_anchor_marker"),
            F.when(F.contains(low, F.lit("[redacted_path]")), "redacted_path_marker"),
            F.when(_has(low, CACHE_PATHS), "cache_or_tmp_path"),
            F.when(F.lower(F.trim("source")).isin(*DIGEST_SOURCES) & (_has(low, STALE_TERMS) | evidence.time_sensitive(both)), "stale_status_snapshot"),
            F.when(((n >= 2400) & (marks >= 1)) | ((n >= 900) & (marks >= 2)), "overlong_transcript"),
            F.when(stale, "stale_review_active"),
            F.when((_meta("memory_type") == "") & (_meta("type") == "") & (_meta("category") == ""), "missing_memory_type"),
            F.when(F.col("content").rlike(text.SECRET), "secret_like_content"),
            F.when(_meta("sensitivity").isin(*SECRET_REFERENCES) & (_meta("vault_ref") == ""), "secret_reference_missing_vault_ref"),
        )
    )


def quality_rules(corpus: DataFrame) -> DataFrame:
    """(id, rule): every rule that a row of the active profile breaks."""
    return corpus.where(policy.profile_visible()).select("id", F.explode(lint_rules()).alias("rule"))


def quality_decisions(corpus: DataFrame) -> DataFrame:
    """(id, target, source, action, risk, reason, updated_at): what to do with each row, the first reason that holds.

    Active rows need a review if they break a rule; candidates are kept, archived or promoted.
    """
    low = F.lower(F.concat_ws("\n", "summary", "content"))
    kind, target = _meta("memory_type"), F.lower(F.trim("target"))
    number = lambda k: F.coalesce(policy.json_text("metadata", f"$.{k}").cast("double"), F.lit(0.0))
    sure, weight = number("confidence"), number("importance")
    rules = F.when(policy.profile_visible(), lint_rules()).otherwise(F.array().cast("array<string>"))
    say = lambda action, reason, risk="low": F.struct(F.lit(action).alias("action"), F.lit(risk).alias("risk"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    reasons = F.concat(F.lit("active_lint_rules:"), F.array_join(F.sort_array("rules"), ","))
    active = F.when(F.array_contains("rules", "secret_like_content"), say("needs_review", reasons, "high")).when(F.size("rules") > 0, say("needs_review", reasons, "medium")).otherwise(say("skip", "not_candidate"))
    stale = _meta("expires_at").isin(*STALE_REVIEW) | _meta("freshness").isin(*STALE_REVIEW) | _meta("review_status").isin(*STALE_REVIEW)
    candidate = (
        F.when(~target.isin(*PROFILE_TARGETS), say("keep_candidate", "target_not_profile_surface"))
        .when(F.col("content").rlike(text.SECRET), say("keep_candidate", "secret_like_content_requires_human_review", "high"))
        .when(stale, say("keep_candidate", "stale_review_requires_operator_review", "medium"))
        .when(_has(low, REVIEW_TERMS), say("keep_candidate", "high_risk_terms_require_human_review", "high"))
        .when(kind.isin(*NOISE_TYPES), say("archive", F.concat(F.lit("low_value_memory_type:"), kind)))
        .when(_has(low, PROGRESS_TERMS) & kind.isin("summary", "decision", "project"), say("archive", "stale_progress_or_release_status"))
        .when(~kind.isin(*STABLE_TYPES), say("keep_candidate", F.concat(F.lit("unsupported_memory_type:"), F.when(kind == "", "unknown").otherwise(kind))))
        .when(policy.json_text("metadata", "$.evidence_refs").isNull(), say("keep_candidate", "missing_evidence_anchor", "medium"))
        .when((target == "user") & (sure >= 0.78), say("promote", "user_profile_candidate_confident"))
        .when((F.lower("source") == "tool-store") & (sure >= 0.86) & (weight >= 0.55), say("promote", "tool_store_candidate_confident"))
        .when((sure >= 0.78) & (weight >= 0.55), say("promote", "high_confidence_stable_candidate"))
        .when((weight >= 0.82) & (sure >= 0.62), say("promote", "high_importance_stable_candidate"))
        .otherwise(say("keep_candidate", "below_auto_promotion_threshold"))
    )
    rows = corpus.withColumn("rules", rules)
    rows = rows.withColumn("d", F.when(policy.lifecycle() == "candidate", candidate).otherwise(active))
    return rows.select("id", "target", "source", "d.action", "d.risk", "d.reason", "updated_at")


def lane() -> Column:
    """The queue that a decision goes to."""
    a = F.col("action")
    return F.when(a == "promote", "promote_safe").when(a == "archive", "archive_low_value").when(a == "skip", "skip").when(F.col("risk") == "high", "needs_review_high_risk").when(F.col("reason") == "below_auto_promotion_threshold", "defer_recent").otherwise("needs_review")


def transcript_copies(candidates: DataFrame, sources: DataFrame, least: int = 600, size: int = 8, share: float = 0.75, most: int = 16_000) -> DataFrame:
    """(id, overlap, copied): candidates whose shingles of characters at stride 8 mostly occur in their group's sources.

    Shorter candidates than ``least`` never are copies and longer ones than ``most`` always. Shingles meet by a join on (group,
    shingle), so that no group's text is held in one task.
    """
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    # one pass of a pattern for all shingles: substring() would walk the text from its start for each
    blocks = F.regexp_extract_all("t", F.lit(f"(?s).{{{size}}}"), F.lit(0))
    last = F.when(F.char_length("t") % size != 0, F.array(F.right("t", F.lit(size)))).otherwise(F.array().cast("array<string>"))
    sliding = F.when(F.char_length("t") <= size, F.array("t")).otherwise(F.regexp_extract_all("t", F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
    c = candidates.select("id", "group", F.char_length("content").alias("raw"), flat("content").alias("t"))
    own = c.where(F.char_length("t") >= least).select("id", "group", F.explode(F.concat(blocks, last)).alias("g")).select("id", "group", F.xxhash64("g").alias("g"))
    seen = sources.select("group", flat("content").alias("t")).select("group", F.explode(F.array_distinct(F.transform(sliding, lambda g: F.xxhash64(g)))).alias("g"))
    total = own.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    hit = own.join(seen, ["group", "g"], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
    share_of = F.coalesce("hits", F.lit(0)) / F.col("n")
    rows = c.join(total, "id", "left").join(hit, "id", "left").withColumn("overlap", F.coalesce(share_of, F.lit(0.0)))
    return rows.select("id", "overlap", ((F.col("raw") > most) | (F.col("n").isNotNull() & (F.col("overlap") >= share))).alias("copied"))


def queue(rows: DataFrame, now: str) -> DataFrame:
    """One row: how a work queue stands and how old its oldest waiting entry is."""
    waiting = F.col("status").isin("pending", "claimed")
    age = F.lit(now).cast("timestamp").cast("long") - F.min(F.when(waiting, F.col("available_at"))).cast("timestamp").cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "claimed").alias("claimed"),
        F.count_if(F.col("status") == "dead").alias("dead"), F.max("attempts").alias("most_attempts"), F.coalesce(age, F.lit(0).cast("long")).alias("oldest_s"),
    )


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def orphans(truth: DataFrame, parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(part, rows, orphans, hidden): rows of companion tables whose ids (id, hidden) lacks, or has as hidden."""
    out = []
    for name, (rows, columns) in parts.items():
        lost, hidden = F.lit(False), F.lit(False)
        for k, c in enumerate(columns):
            rows = rows.join(truth.select(F.col("id").alias(f"_i{k}"), F.col("hidden").alias(f"_h{k}")), F.col(c) == F.col(f"_i{k}"), "left")
            lost, hidden = lost | F.col(f"_i{k}").isNull(), hidden | F.coalesce(f"_h{k}", F.lit(False))
        out.append(rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(lost).alias("orphans"), F.count_if(hidden).alias("hidden")).select(F.lit(name).alias("part"), "rows", "orphans", "hidden"))
    return stacked(out)


def graph_stats(memories: DataFrame, relations: DataFrame) -> DataFrame:
    """For each type of relation: how many, from how many memories, with a lost or hidden end, and within one scope.

    ``memories`` are (id, scope_id, there, hidden).
    """
    end = lambda x: memories.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("scope_id", "there", "hidden")))
    rows = relations.join(end("s"), F.col("source_memory_id") == F.col("s"), "left").join(end("t"), F.col("target_memory_id") == F.col("t"), "left")
    gone = lambda x: ~F.coalesce(f"there_{x}", F.lit(False))
    hid = lambda x: F.coalesce(F.col(f"there_{x}") & F.col(f"hidden_{x}"), F.lit(False))
    return rows.groupBy("relation_type").agg(
        F.count(F.lit(1)).alias("relations"), F.countDistinct("source_memory_id").alias("sources"), F.count_if(gone("s") | gone("t")).alias("orphans"),
        F.count_if(hid("s") | hid("t")).alias("hidden_peers"), F.count_if(F.col("scope_id_s") == F.col("scope_id_t")).alias("scoped"),
    )
