"""Scans, upserts and deletes of memory relations as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import policy
from ..sources.scratch import written


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table of few files dealt over all cores; tables that fill the cores already are left as they are.

    Costs one shuffle of the rows, which is small exactly where it happens.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows


def scoped(corpus: DataFrame, scopes: Sequence[str], visible: Column | None = None) -> DataFrame:
    """Rows of the given scopes, by default those that ordinary recall sees. Both predicates reach the scan where they can."""
    return corpus.where(F.col("scope_id").isin(*scopes)).where(policy.ordinary_visible() if visible is None else visible)


def newest(corpus: DataFrame, limit: int, target: str | None = None, scope: str | None = None) -> DataFrame:
    """The newest rows of a target and a scope; ties by id. Needs no full sort: Spark keeps ``limit`` rows a task."""
    for column, value in (("target", target), ("scope_id", scope)):
        if value is not None:
            corpus = corpus.where(F.col(column) == value)
    return corpus.orderBy(F.desc("updated_at"), "id").limit(limit)


def page(corpus: DataFrame, after: tuple, upto: tuple, limit: int) -> DataFrame:
    """The next rows by (updated_at, id) after a cursor and up to a bound."""
    at = F.struct("updated_at", "id")
    low, high = (F.struct(F.lit(t).cast("timestamp").alias("updated_at"), F.lit(i).alias("id")) for t, i in (after, upto))
    return corpus.where((at > low) & (at <= high)).orderBy("updated_at", "id").limit(limit)


def missing(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def latest_by(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the given order. Spark keeps one candidate a key and task before it shuffles."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the place of each row among those of its keys, from 1, without bringing a hot key into one task.

    Rows are dealt to ranges of the order, as many as the session shuffles to, and counted there; the counts of the ranges before
    give each range's offset. Rows alike in keys and order may stand in any order among themselves.
    """
    cut = rows.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id())
    local = cut.withColumn("_r", F.row_number().over(W.partitionBy("_p", *keys).orderBy(*order)))
    local = written(local)
    counts = local.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).select("_o", *(F.col(k).alias(f"_k{n}") for n, k in enumerate((*keys, "_p"))))
    same = F.lit(True)
    for n, k in enumerate((*keys, "_p")):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return local.join(offsets, same).select(*rows.columns, (F.col("_r") + F.col("_o")).cast("long").alias(out))


def pages(rows: DataFrame, size: int) -> DataFrame:
    """(page, n, first_id, last_id) of a walk by (updated_at, id): each page's cursor is its last row."""
    placed = ranked(rows.select("id", "updated_at").withColumn("_all", F.lit(1)), ["_all"], [F.col("updated_at"), F.col("id")], "place")
    page = F.floor((F.col("place") - 1) / size).alias("page")
    return placed.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "place").alias("first_id"), F.max_by("id", "place").alias("last_id"))


def upsert(state: DataFrame, changes: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """State with each changed row replaced by its newest version, and new rows added."""
    tagged = state.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest_by(tagged, key, F.desc("_new"), *newest_first).drop("_new")


def delete(state: DataFrame, doomed: DataFrame, key: str, doomed_key: str | None = None) -> DataFrame:
    """State without the doomed keys."""
    gone = doomed.select(F.col(doomed_key or key).alias("_gone")).distinct()
    return state.join(gone, state[key] == gone["_gone"], "left_anti")


def insert_new(state: DataFrame, batch: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Rows of the batch that a visible row of the same key does not hold yet; the first of each key."""
    return latest_by(batch, key, order).join(state.where(policy.ordinary_visible()).select(*key), key, "left_anti")


def chunks(text: Column, size: int) -> Column:
    """A text in pieces of at most ``size`` characters, cut after a sentence or a word where there is one."""
    piece = rf"(?s).{{1,{size - 1}}}[.!?\n](?=\s|$)|.{{1,{size - 1}}}\s|.{{1,{size}}}"
    found = F.regexp_extract_all(text, F.lit(piece), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def bundles(messages: DataFrame, session: str, order: str, *fields: str) -> DataFrame:
    """The messages of each session as one sorted array."""
    rows = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return messages.groupBy(session).agg(F.count(F.lit(1)).alias("n"), rows.alias("messages"))


def fits_budget(ranked: DataFrame, partition: str, order: str, length: Column, most: int) -> DataFrame:
    """The prefix of each partition's ranking whose running length stays within a budget."""
    run = F.sum(length).over(W.partitionBy(partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("used", run).where(F.col("used") <= most)


def day_bounds(day: str, zone: str) -> tuple[Column, Column]:
    """A local day as two instants without a zone, in UTC; [start, end) is 23 to 25 hours."""
    at = lambda d: F.to_utc_timestamp(F.to_timestamp(F.lit(d)), zone)
    return at(f"{day} 00:00:00").cast("timestamp_ntz"), F.to_utc_timestamp(F.to_timestamp(F.date_add(F.to_date(F.lit(day)), 1)), zone).cast("timestamp_ntz")


def day_bundles(messages: DataFrame, day: str, zone: str, session: str, time: str, order: str, *fields: str) -> DataFrame:
    """``bundles`` of the messages of one local day; fields that the table lacks are null."""
    start, end = day_bounds(day, zone)
    rows = messages.where((F.col(time) >= start) & (F.col(time) < end))
    rows = rows.withColumns({f: F.lit(None).cast("string") for f in fields if f not in rows.columns})
    return bundles(rows, session, order, *fields)


def cascade(doomed: DataFrame, companions: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Companion tables without the rows that name a doomed id in one of their columns."""
    out = {}
    for name, (rows, columns) in companions.items():
        for c in columns:
            rows = delete(rows, doomed, c, "id")
        out[name] = rows
    return out
