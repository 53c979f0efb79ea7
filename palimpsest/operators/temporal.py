"""A bitemporal ledger of claims: reads at an instant, integrity, and transitions as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import policy
from .scan import ranked

SLOT = ["scope_id", "subject_key", "predicate_key"]


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def current(claims: DataFrame, at: str) -> DataFrame:
    return claims.where(policy.current_claim(instant(at)))


def as_of(claims: DataFrame, valid_at: str, known_at: str | None = None) -> DataFrame:
    """Claims valid at an instant, as they were known at another.

    What was recorded later is not known yet; a retirement that came later is undone, and with it the end of validity that it
    recorded.
    """
    if known_at is None:
        return claims.where(policy.valid_at(instant(valid_at)))
    known = instant(known_at)
    undone = F.col("retired_at") > known
    seen = claims.where(F.col("recorded_at") <= known)
    seen = seen.withColumn("valid_to", F.when(~F.coalesce(undone, F.lit(False)), F.col("valid_to")))
    seen = seen.withColumn("status", F.when(undone, "current").otherwise(F.col("status")))
    seen = seen.withColumn("retired_at", F.when(~F.coalesce(undone, F.lit(False)), F.col("retired_at")))
    return seen.where(policy.valid_at(instant(valid_at)))


def history(claims: DataFrame) -> DataFrame:
    """Each slot's claims in order, with their place and predecessor."""
    order = W.partitionBy(*SLOT).orderBy(F.asc_nulls_first("valid_from"), "recorded_at", "claim_id")
    return claims.withColumn("place", F.row_number().over(order).cast("long")).withColumn("previous", F.lag("claim_id").over(order))


def predecessors(claims: DataFrame) -> DataFrame:
    """(successor, predecessor, conflict): the first superseded claim of each successor, and whether there is another."""
    order = W.partitionBy("superseded_by_claim_id").orderBy("recorded_at", "claim_id")
    rows = claims.where("superseded_by_claim_id IS NOT NULL").withColumn("n", F.row_number().over(order)).where("n <= 2")
    return rows.groupBy(F.col("superseded_by_claim_id").alias("successor")).agg(F.max(F.when(F.col("n") == 1, F.col("claim_id"))).alias("predecessor"), (F.max("n") >= 2).alias("conflict"))


def overlapping(claims: DataFrame) -> DataFrame:
    """(``SLOT``, a, b): for each claim ``b`` that an earlier one of its slot reaches into, the one that reaches furthest.

    One link for each overlapped claim, not every pair (``overlapping_pairs``): a slot is free of overlaps if it has no row. A
    running maximum of ends finds it, so that a slot is sorted once.
    """
    order = W.partitionBy(*SLOT).orderBy(F.asc_nulls_first("valid_from"), "claim_id").rowsBetween(W.unboundedPreceding, -1)
    end = F.coalesce(F.col("valid_to").cast("timestamp").cast("double"), F.lit(float("inf")))
    rows = claims.withColumn("furthest", F.max(F.struct(end.alias("end"), F.col("claim_id").alias("id"))).over(order))
    start = F.coalesce(F.col("valid_from").cast("timestamp").cast("double"), F.lit(float("-inf")))
    return rows.where(F.col("furthest.end") > start).select(*SLOT, F.col("furthest.id").alias("a"), F.col("claim_id").alias("b"))


#: Nodes of a binary tree over ranks that together cover the ranks from l to r - 1, none of them twice: two a level at most.
_COVER = """flatten(transform(sequence(0, CAST(floor(log2(r - l)) AS INT) + 1), k -> filter(array(
  CASE WHEN shiftright(l + shiftleft(1L, k) - 1, k) < shiftright(r, k) AND shiftright(l + shiftleft(1L, k) - 1, k) % 2 = 1 THEN struct(k AS level, shiftright(l + shiftleft(1L, k) - 1, k) AS node) END,
  CASE WHEN shiftright(l + shiftleft(1L, k) - 1, k) < shiftright(r, k) AND shiftright(r, k) % 2 = 1 THEN struct(k AS level, shiftright(r, k) - 1 AS node) END
), x -> x IS NOT NULL)))"""


def overlapping_pairs(claims: DataFrame) -> DataFrame:
    """(``SLOT``, a, b): every pair of a slot's claims of which the later one, ``b``, begins while ``a`` is still valid.

    An interval join without comparing all pairs. Beginnings and ends of a slot are ranked together, an end before a beginning
    of the same instant; ``a`` then reaches into ``b`` if the rank of b's beginning lies between its own two. An interval is
    covered by at most two nodes a level of a binary tree over the ranks, and a beginning lies in one node a level, so that each
    pair meets in exactly one node. The equi-join on nodes divides a hot slot, and apart from its result costs
    n log n. An open beginning comes first and an open end last; an empty interval reaches into nothing.
    """
    seconds = lambda c, none: F.coalesce(F.col(c).cast("timestamp").cast("double"), F.lit(none)).alias("t")
    begins = claims.select(*SLOT, "claim_id", seconds("valid_from", float("-inf")), F.lit(1).alias("begins"))
    ends = claims.select(*SLOT, "claim_id", seconds("valid_to", float("inf")), F.lit(0).alias("begins"))
    placed = ranked(begins.unionByName(ends), SLOT, [F.col("t"), F.col("begins"), F.col("claim_id")], "rank")
    both = placed.groupBy(*SLOT, "claim_id").agg(F.max(F.when(F.col("begins") == 1, F.col("rank"))).alias("p"), F.max(F.when(F.col("begins") == 0, F.col("rank"))).alias("r"))
    covers = both.withColumn("l", F.col("p") + 1).where("l < r").select(*SLOT, F.col("claim_id").alias("a"), F.explode(F.expr(_COVER)).alias("n")).select(*SLOT, "a", "n.level", "n.node")
    sizes = both.groupBy(*SLOT).agg((F.ceil(F.log2(2 * F.count(F.lit(1)) + 1)) + 1).cast("int").alias("levels"))
    points = both.join(sizes, SLOT).select(*SLOT, F.col("claim_id").alias("b"), "p", F.explode(F.sequence(F.lit(0), "levels")).alias("level"))
    points = points.select(*SLOT, "b", "level", F.expr("shiftright(p, level)").alias("node"))
    return covers.join(points, [*SLOT, "level", "node"]).select(*SLOT, "a", "b")


def insert_checked(claims: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch with ``rejected``: its interval overlaps an open or closed one of the same slot.

    A slot's claims and newcomers are laid in order of their beginnings. A newcomer overlaps one that begins before it if the
    furthest end so far lies behind its beginning, and one that begins later if the next beginning lies before its end: no
    newcomer meets every claim of a hot slot. Both are running extremes, the second from the end, so that a slot takes a sort
    and one pass each.
    """
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    seconds = lambda c, none: F.coalesce(F.col(c).cast("timestamp").cast("double"), none)
    ends = lambda rows, mine: rows.select(*SLOT, "claim_id", seconds("valid_from", low).alias("f"), seconds("valid_to", high).alias("t"), F.lit(mine).alias("mine"))
    rows = ends(claims, False).unionByName(ends(batch, True))
    before = W.partitionBy(*SLOT).orderBy("f").rangeBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy(*SLOT).orderBy(F.desc("f")).rangeBetween(W.unboundedPreceding, W.currentRow)
    theirs = lambda c: F.when(~F.col("mine"), F.col(c))
    rows = rows.withColumns({"furthest": F.max(theirs("t")).over(before), "next": F.min(theirs("f")).over(after)}).where("mine")
    hit = rows.withColumn("rejected", F.coalesce(F.col("furthest") > F.col("f"), F.lit(False)) | F.coalesce(F.col("next") < F.col("t"), F.lit(False)))
    return batch.join(hit.select("claim_id", "rejected"), "claim_id")


def overlap_conflicts(claims: DataFrame) -> DataFrame:
    """(``SLOT``, overlaps, open): slots of which current claims overlap, and how many of these are open at the end."""
    now = claims.where("status = 'current' AND retired_at IS NULL")
    hit = overlapping(now).groupBy(*SLOT).agg(F.count(F.lit(1)).alias("overlaps"))
    still = now.where("valid_to IS NULL").groupBy(*SLOT).agg(F.count(F.lit(1)).alias("open"))
    return hit.join(still, SLOT, "left").withColumn("open", F.coalesce("open", F.lit(0)).cast("long"))


def bounded(claims: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows; more than that is an error, never a silent cut."""
    rows = claims.limit(limit + 1)
    if rows.count() > limit:
        raise ValueError(f"more than {limit} claims")
    return rows


def close(claims: DataFrame, plan: DataFrame) -> DataFrame:
    """Apply a plan (claim_id, expected_status, new_status, at): rows of the expected status are closed at that instant."""
    rows = claims.join(plan, "claim_id", "left").withColumn("closed", F.coalesce(F.col("status") == F.col("expected_status"), F.lit(False)))
    put = lambda new, old: F.when(F.col("closed"), F.col(new)).otherwise(F.col(old))
    out = {"valid_to": put("at", "valid_to"), "retired_at": put("at", "retired_at"), "status": put("new_status", "status")}
    return rows.withColumns(out).drop("expected_status", "new_status", "at")


def top_evidence(evidence: DataFrame, claim: str, most: int, *order: Column) -> DataFrame:
    return evidence.withColumn("place", F.row_number().over(W.partitionBy(claim).orderBy(*order)).cast("long")).where(F.col("place") <= most)


def interleaved(routes: DataFrame, query: str = "query_id") -> DataFrame:
    """Round robin over routes by rank: each id at its first turn. Needs (query, route, id, rank)."""
    first = routes.withColumn("turn", F.row_number().over(W.partitionBy(query, "id").orderBy("rank", "route"))).where("turn = 1")
    return first.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy("rank", "route", "id")).cast("long")).drop("turn")
