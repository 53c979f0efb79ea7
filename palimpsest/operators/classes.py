"""Questions and rows that share keys, met as classes: those alike in their keys are one row until the pairs are told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .scan import ranked

#: So many members of a class lie in one row while its pairs are dealt to the tasks.
CHUNK = 256


def keyed(rows: DataFrame, id: str, name: str) -> DataFrame:
    """(id, keys, ``name``): the rows with their keys in order, and a name of these, 256 bits of them."""
    keys = F.array_sort(F.array_distinct("keys"))
    return rows.select(id, keys.alias("keys")).where(F.size("keys") > 0).withColumn(name, F.sha2(F.to_json(F.struct("keys")), 256))


def chunked(members: DataFrame, name: str, id: str) -> DataFrame:
    """(``name``, ids): the members of each class in rows of about ``CHUNK``."""
    sizes = members.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64(id), F.ceil(F.col("n") / CHUNK)).alias("part")
    return members.join(sizes, name).groupBy(name, part).agg(F.collect_list(id).alias(f"{id}s")).drop("part")


def expanded(pairs: DataFrame, asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, id, …): every pair of members of the classes (q, d, …) of ``pairs``.

    Chunks of members are dealt evenly, so that a class of many members is the work of many tasks.
    """
    out = [c for c in pairs.columns if c not in ("q", "d")]
    dealt = pairs.join(chunked(asked, "q", "query_id"), "q").join(chunked(rows, "d", "id"), "d").select("query_ids", "ids", *out)
    dealt = dealt.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select(F.explode("query_ids").alias("query_id"), "ids", *out).select("query_id", F.explode("ids").alias("id"), *out)


def sharing(asked: DataFrame, rows: DataFrame, *out: Column) -> DataFrame:
    """(query_id, id, …) of all questions (query_id, keys) and rows (id, keys) that share keys; ``out`` is told of the ``key`` they share."""
    asked, rows = written(keyed(asked, "query_id", "q")), written(keyed(rows, "id", "d"))
    each = lambda x, c: x.dropDuplicates([c]).select(c, F.explode("keys").alias("key"))
    pairs = each(asked, "q").join(each(rows, "d"), "key").groupBy("q", "d").agg(*out)
    return expanded(pairs, asked.select("q", "query_id"), rows.select("d", "id"))


def apart(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, n, first): to how many rows (id, keys) each question (query_id, keys) has no key in common, and the least id among them.

    Both are told from what does share a key: ``n`` by difference, and ``first`` by the classes' ranks of their least ids, of which
    the first one that no sharing class holds is sought. So what has nothing in common never meets.
    """
    asked, rows = written(keyed(asked, "query_id", "q")), written(keyed(rows, "id", "d"))
    classes = rows.groupBy("d").agg(F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).withColumn("all", F.lit(1))
    classes = written(ranked(classes, ["all"], [F.col("first")], "rank"))
    questions = asked.dropDuplicates(["q"])
    pairs = questions.select("q", F.explode("keys").alias("key")).join(classes.select("rank", "n", F.explode("keys").alias("key")), "key").select("q", "rank", "n").distinct()
    pairs = pairs.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("rank")))
    near = pairs.groupBy("q").agg(F.sum("n").alias("near"), F.count_if(F.col("place") == F.col("rank")).alias("held"))
    total = classes.agg(F.sum("n")).first()[0]
    told = questions.select("q").join(near, "q", "left")
    told = told.select("q", (F.lit(total) - F.coalesce("near", F.lit(0))).alias("n"), (F.coalesce("held", F.lit(0)) + 1).alias("rank"))
    return asked.select("query_id", "q").join(told.join(classes.select("rank", "first"), "rank"), "q").select("query_id", "n", "first")
