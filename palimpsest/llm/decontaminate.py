"""Benchmark decontamination in DataFrame functions only.

The windows of the benchmark items form a broadcast hash set keyed by the hash of their first words. Every document position
probes it inside one generated loop; a hit is then verified on the whole window. Nothing but hits is shuffled. A set that is
too large to broadcast is joined in a shuffle of positions' keys, and what meets is verified where the documents are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, join_rows, read_table, row_key, texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Words of a window that its key is the hash of.
PREFIX = 4
#: Benchmark windows (about 100 bytes each) that are broadcast at most; more are joined in a shuffle.
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, NOT_WORD), "")


def window_text(tokens: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(tokens, start + 1, length), " ")


def prefix_key(tokens: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *(F.get(tokens, start + k) for k in range(length)))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, len, prefix, start_key, window): every window of every item that has words."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text").cast("string")).alias("w")
    ).where(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(window)))
    items = items.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))))
    key = F.lit(None).cast("long")
    for n in range(1, PREFIX + 1):
        key = F.when(F.least("len", F.lit(PREFIX)) == n, prefix_key(F.col("w"), F.col("start"), n)).otherwise(key)
    return items.select("item", "len", F.least("len", F.lit(PREFIX)).alias("prefix"), key.alias("start_key"), window_text(F.col("w"), F.col("start"), F.col("len")).alias("window")).distinct()


def window_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, t1, t2, n_words, item, start, len) of every occurrence of a benchmark window in a document.

    Up to ``broadcast_windows`` windows are a hash set at every position. Of more, only the distinct keys of positions (8 bytes
    each, with the row they are of) meet the windows' keys, in one shuffle join whatever the number of windows; the rows that may
    hold a window then read their texts once more.
    """
    found = item_windows(benchmark, window)
    sizes = {r["prefix"]: r["n"] for r in found.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most PREFIX rows
    tokens = texts(docs).select("doc_id", *row_key(), words(F.col("text")).alias("w"))
    at = tokens.select("doc_id", "t1", "t2", "w", F.posexplode("w").alias("start", "_word")).drop("_word")
    keys = [prefix_key(F.col("w"), F.col("start"), n) for n in sorted(sizes)]
    if len(keys) == 1:
        at = at.withColumn("start_key", keys[0])
    else:
        at = at.withColumn("start_key", F.explode(F.array(*keys) if keys else F.array(F.lit(0).cast("long"))))
    columns = ["doc_id", "t1", "t2", F.size("w").alias("n_words"), "item", "start", "len"]
    if sum(sizes.values()) <= broadcast_windows:
        same = (at.start_key == found.start_key) & (found.window == window_text(at.w, at.start, found["len"]))
        return at.join(F.broadcast(found), same).select(*columns)
    here = at.select("doc_id", "t1", "t2", "start", "start_key").join(found, "start_key")
    here = here.select(F.col("doc_id").alias("d"), F.col("t1").alias("h1"), F.col("t2").alias("h2"), "start", "item", "len", "window")
    both = tokens.dropDuplicates(["doc_id", "t1", "t2"]).join(here, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")))
    return both.where(F.col("window") == window_text(F.col("w"), F.col("start"), F.col("len"))).select(*columns).distinct()


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row: doc_id, t1, t2 (the text's hash), n_words, n_hit, n_items, items_sha256, contaminated, and hit_words (positions of hit words).

    A word is hit if it lies in an occurrence of a window of ``window`` words of an item; an item of fewer words, but not
    none, is one window. Contaminated: at least one word in ``share`` is hit. A null text has no words; a null item_id counts
    as the empty string, and items that repeat an id count once. Rows that repeat a doc_id are judged each on its own text, and
    texts of any length whole. Other columns are passed over, whatever their names. An empty benchmark hits nothing, and an
    empty table gives an empty result.
    """
    hits = window_hits(docs, benchmark, window, broadcast_windows)
    hits = hits.groupBy("doc_id", "t1", "t2").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.collect_set("item").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("t1").alias("h1"), F.col("t2").alias("h2"), F.array_sort(covered).alias("hit_words"), F.array_sort("items").alias("items"))
    rows = texts(docs).select("doc_id", *row_key(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.join(hits, rows.doc_id.eqNullSafe(hits.d) & (rows.t1 == hits.h1) & (rows.t2 == hits.h2), "left")
    none = F.array().cast("array<string>")
    out = rows.select(
        "doc_id",
        "t1",
        "t2",
        "n_words",
        F.coalesce(F.size("hit_words"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"),
    )
    out = out.withColumn("n_hit", F.greatest("n_hit", F.lit(0).cast("long"))).withColumn("n_items", F.greatest("n_items", F.lit(0).cast("long")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``judged`` without the text's hash."""
    return judged(docs, benchmark, window, share, broadcast_windows).drop("t1", "t2")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents, with all their columns, that are not contaminated, each row by its own text (see ``judged``).

    Only rows with hits are grouped, and only keys of contaminated rows are joined to the documents. Null and empty texts have no
    words and stay, and so does every row where the benchmark is empty. Columns keep their names and order, whatever they are
    called. An empty table stays empty.
    """
    hits = window_hits(docs, benchmark, window, broadcast_windows)
    hits = hits.groupBy("doc_id", "t1", "t2").agg(F.first("n_words").alias("n_words"), F.collect_set(F.struct("start", "len")).alias("spans"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    bad = hits.where(F.lit(share) * n_hit >= F.col("n_words")).select("doc_id", "t1", "t2")
    return join_rows(docs, Workspace(docs.sparkSession).save(bad, "contaminated"), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("hit_words")


OP7_SQL = rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '') AS w
  FROM benchmark),
b1 AS (SELECT item, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
b2 AS (SELECT item, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b1),
b3 AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM b2),
lens AS (SELECT DISTINCT n FROM b3),
d1 AS (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, lens WHERE len(w) >= n),
d2 AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM d1),
h AS (SELECT DISTINCT d2.r, d2.i, d2.n, b3.item FROM d2 JOIN b3 ON d2.n = b3.n AND d2.win = b3.win),
p AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
