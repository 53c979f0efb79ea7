"""Importance resampling towards a target, by an integer dictionary of words.

Distinct words get ids, runs of words become tuples of ids, and each distinct tuple's text is put together and hashed once,
whatever the number of its occurrences; the counts of its bucket are then joined back. A document's weight is the mean of its
features' gains, the logarithm of how much likelier their buckets are in the target than in the corpus. The documents drawn
are those of the highest weight plus a Gumbel number that their doc_id decides: sampling without replacement.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .coding import CHUNK_WORDS, LETTERS, PART_BYTES, code, sums
from .common import Workspace, read_table, texts
from .decontaminate import LOWER, NOT_WORD, UPPER

RUNS, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20


def gains(counts: dict[int, tuple[int, int]], buckets: int) -> list[tuple[int, int]]:
    """(bucket, gain) of the buckets that are not empty, from their numbers of features in the corpus and in the target."""
    s_all, t_all = sum(s for s, _ in counts.values()), sum(t for _, t in counts.values())
    return [(b, math.floor(1000 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))))) for b, (s, t) in counts.items()]


def gumbel(doc_id: Column, seed: int) -> Column:
    """A number that doc_id decides, 1000 times Gumbel distributed. A null doc_id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def feature_values(coded: DataFrame, ws: Workspace, runs: int, buckets: int) -> DataFrame:
    """(chunk, id, gain) of every feature of every chunk.

    Words are joined to the dictionary, and for longer runs tuples to the tuples' table, both in shuffles: a word or tuple
    has at most one row a chunk. Of the gains there are at most ``buckets``, and these are broadcast.
    """
    words = coded.where("kind = 'w'")
    counted = words.groupBy("word").agg(F.sum("n0").alias("s"), F.sum("n1").alias("t"))
    dictionary = counted.withColumn("word_id", F.monotonically_increasing_id())
    if runs == 1:  # a tuple is a word: its id says nothing more
        own = words.select("chunk", "id", "word")
        features, key = ws.save(dictionary.withColumn("bucket", F.crc32("word") % buckets), "tuples"), "word"
    else:
        dictionary = ws.save(dictionary.select("word", "word_id"), "dictionary")
        of_word = words.join(dictionary, "word").select("chunk", F.col("id").alias("w"), "word_id")
        spread = coded.where("kind = 'f'").select("chunk", "id", "n0", "n1", F.posexplode("tuple").alias("at", "w")).join(of_word, ["chunk", "w"])
        ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "word_id"))), lambda x: x["word_id"])
        own = ws.save(spread.groupBy("chunk", "id").agg(ids.alias("ids"), F.first("n0").alias("n0"), F.first("n1").alias("n1")), "features")
        distinct = own.groupBy("ids").agg(F.sum("n0").alias("s"), F.sum("n1").alias("t"))
        spelt = distinct.select("ids", "s", "t", F.posexplode("ids").alias("at", "word_id")).join(dictionary, "word_id")
        spelt = spelt.groupBy("ids").agg(F.first("s").alias("s"), F.first("t").alias("t"), F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w"))
        run = F.array_join(F.transform("w", lambda x: x["word"]), " ")
        features, key = ws.save(spelt.select("ids", "s", "t", (F.crc32(run.cast("binary")) % buckets).alias("bucket")), "tuples"), "ids"
    rows = features.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # at most ``buckets`` rows
    gain = coded.sparkSession.createDataFrame(gains({r["bucket"]: (r["s"], r["t"]) for r in rows}, buckets), "bucket long, gain long")
    return own.join(features.select(key, "bucket"), key).join(F.broadcast(gain), "bucket").select("chunk", "id", "gain")


def ranked_draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Add ``rank`` to the ``percent`` of the rows with enough words that score highest, ties to the smaller doc_id (null first).

    Scores are whole numbers between bounds that logarithms of doubles set, some 200,000 values at most, so that the counts
    by score fit the driver whatever the number of rows. Within a score, rows are ranked by doc_id; the Gumbel number keeps
    the share of any score under one in 2,000 doc_ids, and rows alike in all are one row with a count.
    """
    fit = (F.col("n") >= least_words).alias("fit")
    alike = scored.groupBy("doc_id", "n_features", "weight", "score", fit).agg(F.count(F.lit(1)).alias("same"))
    counts = sorted(scored.where(F.col("n") >= least_words).groupBy("score").count().collect(), reverse=True)
    room, above, before = percent * sum(r[1] for r in counts) // 100, [], 0
    for score, n in counts:
        if before >= room:
            break
        above.append((score, before))
        before += n
    offsets = scored.sparkSession.createDataFrame(above, "score long, before long")
    order = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "weight", "n_features").rowsBetween(W.unboundedPreceding, W.currentRow)
    drawn = alike.where("fit").join(F.broadcast(offsets), "score").withColumn("last", F.col("before") + F.sum("same").over(order))
    drawn = drawn.withColumn("rank", F.explode(F.sequence(F.col("last") - F.col("same") + 1, F.col("last"))))
    rest = alike.join(F.broadcast(offsets.select("score", F.lit(True).alias("seen"))), "score", "left").where("not fit or seen is null")
    rest = rest.withColumn("rank", F.explode(F.array_repeat(F.lit(None).cast("long"), F.col("same").cast("int"))))
    columns = ["doc_id", "n_features", "weight", "score"]
    return drawn.select(*columns, F.when(F.col("rank") <= room, F.col("rank")).alias("rank")).unionByName(rest.select(*columns, "rank"))


def resample(
    docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, chunk_words: int = CHUNK_WORDS, part_bytes: int = PART_BYTES
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank is null for those that are not drawn.

    Features are all runs of 1 to ``runs`` words of a text, repeats counted; null and empty texts have none and weight 0. Rows
    that repeat a doc_id are weighed each by its own text and have the same Gumbel number; of equal scores the smaller doc_id
    comes first, null before all, and rows alike in all take ranks that follow one another. Texts of any length are counted
    whole, in parts. Columns other than doc_id and text are passed over, whatever their names. An empty target gives every
    bucket what its count in the corpus says; an empty corpus gives an empty result.
    """
    if runs < 1 or buckets < 1:
        raise ValueError("runs and buckets are 1 at least")
    ws = Workspace(docs.sparkSession)
    mine, other = texts(docs, binary=True), target.select(F.col("text").cast("string").cast("binary").alias("text"))
    doc_type = mine.schema["doc_id"].dataType
    rows = mine.withColumn("side", F.lit(0)).unionByName(other.select(F.lit(None).cast(doc_type).alias("doc_id"), "text", F.lit(1).alias("side")))
    coded = ws.save(code(rows, LETTERS, runs, chunk_words, part_bytes), "coded")
    added = sums(coded, feature_values(coded, ws, runs, buckets), {"gain": "long"}).where("side = 0")
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("gain") / F.col("n_features"))).otherwise(0).cast("long")
    scored = added.select("doc_id", "n", "n_features", weight.alias("weight"))
    return ranked_draw(ws.save(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored"), percent, least_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The checksum's table is worked out bit by bit, and then a byte at a time looked up in it.
OP11_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '') AS w
  FROM documents),
b AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '')) AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS w FROM d),
bits AS (
  SELECT 0 AS k, v AS c0, CAST(v AS BIGINT) AS c FROM range(256) AS t(v)
  UNION ALL SELECT k + 1, c0, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
step AS (SELECT list(c ORDER BY c0) AS t FROM bits WHERE k = 8),
vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM b)),
spelt AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM vocabulary),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM spelt, step),
sc AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY bucket),
tc AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM b) AS t_all),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + {BUCKETS}) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (t_all + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN sc USING (bucket) LEFT JOIN tc USING (bucket), totals),
doc AS (SELECT r, sum(gain) AS gain FROM dw JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY r),
weighed AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(CASE WHEN len(w) > 0 THEN floor(CAST(gain AS DOUBLE) / len(w)) ELSE 0 END AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN doc USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)
"""
