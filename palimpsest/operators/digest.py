"""From conversations to candidate memories: segments, sentences, classes and the best existing match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import evidence, policy, text
from ..sources.scratch import written
from .recall import top
from .reports import transcript_copies

#: Letters from which a word may carry a topic.
TOPIC_LETTERS = 4


def topic_words(content: str) -> Column:
    return F.filter(text.semantic_tokens(content), lambda w: F.char_length(w) >= TOPIC_LETTERS)


def segments(entries: DataFrame) -> DataFrame:
    """Entries (session_id, turn_number, role, content) with the number of their segment in the session.

    A user turn with topic words, none of which occur in the segment so far, begins a new one if that segment has any. Whether
    it does is a question of two numbers: where one of its words occurred last, and where any topic word did; both lie before
    the segment's beginning, or do not. Windows by session and word find them, so that what a session is folded over are its
    user turns' numbers and no texts or growing sets.
    """
    order = W.partitionBy("session_id").orderBy("turn_number", "role", "content")
    rows = entries.select("session_id", "turn_number", "role", "content", topic_words("content").alias("words")).withColumn("pos", F.row_number().over(order))
    said = rows.select("session_id", "pos", F.explode("words").alias("word"))
    again = said.withColumn("last", F.lag("pos").over(W.partitionBy("session_id", "word").orderBy("pos")))
    shared = again.groupBy("session_id", "pos").agg(F.coalesce(F.max("last"), F.lit(0)).alias("shared"))
    before = F.max(F.when(F.size("words") > 0, F.col("pos"))).over(W.partitionBy("session_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    asks = rows.withColumn("spoken", F.coalesce(before, F.lit(0))).where("role = 'user'").join(shared, ["session_id", "pos"])
    turns = asks.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", "shared", "spoken"))).alias("turns"))
    start = F.struct(F.lit(1).alias("start"), F.array().cast("array<int>").alias("cuts"))
    new = lambda s, t: (t["shared"] < s["start"]) & (t["spoken"] >= s["start"])
    step = lambda s, t: F.when(new(s, t), F.struct(t["pos"].alias("start"), F.concat(s["cuts"], F.array(t["pos"])).alias("cuts"))).otherwise(s)
    cuts = turns.select("session_id", F.explode(F.aggregate("turns", start, step, lambda s: s["cuts"])).alias("pos"), F.lit(1).alias("cut"))
    placed = rows.drop("words").join(cuts, ["session_id", "pos"], "left")
    segment = F.count("cut").over(W.partitionBy("session_id").orderBy("pos"))
    return placed.select("session_id", "turn_number", "role", "content", segment.cast("int").alias("segment"))


def classified(content: Column) -> Column:
    """A memory type by the first rule that holds."""
    low = F.lower(content)
    return (
        F.when(low.rlike(r"\b(prefer|prefers|like|likes|favorite)\b"), "preference")
        .when(low.rlike(r"\b(decided|decision|we will|agreed)\b"), "decision")
        .when(low.rlike(r"\b(deploy|deployed|release|restart)\b"), "procedure")
        .when(low.rlike(r"\b(error|failed|bug|pitfall|never)\b"), "pitfall")
        .otherwise("factual")
    )


def candidates(entries: DataFrame, least: int = 20, most: int = 400) -> DataFrame:
    """(scope_id, session_id, candidate, memory_type) of user sentences of a fitting length, each once in its scope."""
    said = entries.where("role = 'user'").select("scope_id", "session_id", F.explode(text.split_sentences("content")).alias("candidate"))
    said = said.where(F.char_length("candidate").between(least, most)).withColumn("dedup_key", text.dedup_key("candidate"))
    first = said.groupBy("scope_id", "dedup_key").agg(F.min(F.struct("session_id", "candidate")).alias("s"))
    return first.select("scope_id", "s.session_id", "s.candidate", "dedup_key").withColumn("memory_type", classified(F.col("candidate")))


#: So many known rows are broadcast at most, a hash and some hundred words each.
BROADCAST_KNOWN = 2_500


def best_match(found: DataFrame, corpus: DataFrame, newest: int = 250, skip: float = 0.88, review: float = 0.55) -> DataFrame:
    """Each candidate's most similar row among the ``newest`` of its target, and what follows: skip, review or insert.

    The bound is the operator's own rule: older rows are not compared. So at most ``newest`` rows a target meet a candidate.
    """
    late = top(corpus.where(policy.ordinary_visible()).select("id", "target", "updated_at"), "target", newest, F.desc("updated_at"), F.col("id")).select("id")  # no text is sorted for it
    own = lambda content, *keep: (*keep, F.sha2("dedup_key", 256), text.canonical(text.query_tokens(content)))
    known = corpus.join(F.broadcast(late), "id", "left_semi").select(*own("content", "id", "target")).toDF("id", "target", "key", "known")
    known = written(known)  # ``newest`` rows a target
    asked = found.select(*own("candidate", "candidate_id", "target")).toDF("candidate_id", "target", "dedup_key", "asked")
    pairs = asked.join(F.broadcast(known) if known.count() <= BROADCAST_KNOWN else known, "target")
    score = F.when(F.col("dedup_key") == F.col("key"), 1.0).otherwise(text.similarity(F.col("asked"), F.col("known")))
    best = pairs.groupBy("candidate_id").agg(F.max_by(F.struct(score.alias("score"), "id"), F.struct(F.round(score, 9), F.col("id"))).alias("b"))
    action = F.when(F.col("b.score") >= skip, "skip").when(F.col("b.score") >= review, "review").otherwise("insert")
    return best.select("candidate_id", F.col("b.id").alias("match_id"), F.col("b.score").alias("score"), action.alias("action"))


def budgeted(items: DataFrame, group: str, order: str, most_items: int, most_chars: int, clip: int) -> DataFrame:
    """Evidence in order, each clipped, up to a number of items and characters: the fold over each group's kept lengths."""
    ranked = F.sort_array(F.collect_list(F.struct(F.col(order).alias("rank"), "id", F.left("content", F.lit(clip)).alias("content"))))
    step = lambda s, x: F.when(
        (s["n"] < most_items) & (s["used"] + F.char_length(x["content"]) <= most_chars),
        F.struct((s["n"] + 1).alias("n"), (s["used"] + F.char_length(x["content"])).alias("used"), F.concat(s["out"], F.array(x["id"])).alias("out")),
    ).otherwise(s)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))
    return items.groupBy(group).agg(ranked.alias("items")).select(group, F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("id"))


SLOT = ["scope_id", "subject_key", "predicate_key"]
SLOT_TYPES = ("factual", "preference", "project", "resource", "constraint")


def quarantine(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """(candidate_id, reasons) of every candidate of a batch that stays out of recall, with all its reasons.

    ``candidates`` (candidate_id, session_id, memory_type, content, scope_id, subject_key, predicate_key, cardinality, action, value)
    are judged by their own text (``evidence.pollution``), by the session they come from (a candidate that copies its transcript,
    or tells of a success where the transcript tells of failures alone) and by each other: where a batch adds or
    supersedes several values for one single-valued slot, all of them are out, since none can be told right. ``sources``
    (session_id, content) are the transcripts. Candidates meet sessions by hashes of pieces, and each other by the least and the
    greatest value of a slot: no session, slot or batch meets in one task.
    """
    own = candidates.select("candidate_id", F.explode(evidence.pollution("content", F.col("memory_type"))).alias("reason"))
    texts = lambda rows, *more: rows.select(*more, F.col("session_id").alias("group"), "content")
    copied = transcript_copies(texts(candidates, F.col("candidate_id").alias("id")), texts(sources)).where("copied")
    copied = copied.select(F.col("id").alias("candidate_id"), F.lit("source_transcript_copy").alias("reason"))
    says = lambda p: F.col("content").rlike(p)
    ends = sources.groupBy("session_id").agg(F.bool_or(says(evidence.FAILURE)).alias("failed"), F.bool_or(says(evidence.SUCCESS)).alias("passed"))
    told = candidates.where(says(evidence.SUCCESS) & ~says(evidence.FAILURE)).join(ends.where("failed AND NOT passed"), "session_id", "left_semi")
    told = told.select("candidate_id", F.lit("outcome_contradicts_source").alias("reason"))
    slots = candidates.where("cardinality = 'single' AND action IN ('add', 'supersede')").where(F.col("memory_type").isin(*SLOT_TYPES))
    several = slots.groupBy(*SLOT).agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low <> high")
    clash = slots.join(several, SLOT, "left_semi").select("candidate_id", F.lit("same_batch_single_value_conflict").alias("reason"))
    every = own.unionByName(copied).unionByName(told).unionByName(clash)
    return every.groupBy("candidate_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
