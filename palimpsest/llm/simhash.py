"""SimHash near-duplicates, searched by multi-index hashing (Norouzi, Punjani and Fleet 2012).

Fingerprints of 64 bits within 2 of each other are found over two segments of 32 bits. With radius 2 = 2 * 1 + 0, it is
enough to search the first table with radius 1 and the second with radius 0: two fingerprints that far apart agree in one
half or differ by one bit in either. Instead of flipping bits at query time, both sides of a pair clear the same bit of the
segment, so that a ball is one key lookup and a bucket holds the fingerprints of one ball.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, free_name, join_rows, read_table, row_key, texts
from .graph import connected_components

#: A bucket with more fingerprints than this is searched by balls within its other segment instead of by comparing pairs.
PAIRWISE = 64
LOW = 0xFFFFFFFF
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash over shingles of whole words, repeats included. No words: 0."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(_hash, shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, keyed: bool = False) -> DataFrame:
    """(doc_id, fp bigint) of every row, or (doc_id, t1, t2, fp) with the text's hash; a null text has no words."""
    rows = texts(docs).select("doc_id", *row_key(), F.col("text").cast("binary").alias("text")) if keyed else texts(docs, binary=True)
    keys = [f for f in rows.schema if f.name != "text"]
    names = [f.name for f in keys]

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in b.column("text").to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(fps.view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", fp bigint")


def links(ws: Workspace, fps: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (u, v) over distinct fingerprints ``fp``, so that those within 2 bits are connected and no others are.

    Every pair within 2 bits is an edge or joined through others that are; all edges are verified on all 64 bits. Within a
    bucket of up to ``pairwise`` members, pairs are compared. A larger one is divided by the other segment with every two
    bits (every one, for the ball of one bit) cleared, whose groups hang under their smallest member: work stays linear in
    the members, and none is left out.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW))
    clear = lambda c, *bits: c.bitwiseAND(F.lit(LOW & ~sum(1 << b for b in bits)))
    keys = F.array(
        F.struct(F.lit(-2).alias("table"), high.alias("key")),
        F.struct(F.lit(-1).alias("table"), low.alias("key")),
        *(F.struct(F.lit(i).alias("table"), clear(high, i).alias("key")) for i in range(32)),
    )
    # a fingerprint becomes 34 rows: the few files of a small table would leave most cores without work
    dealt = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = dealt.select("fp", F.explode(keys).alias("k")).select("fp", "k.table", "k.key")
    many = index.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark sizes an exploded table by its source and may broadcast what is 34 times that: these joins are merges
    hits = ws.save(index.join(many.hint("merge"), ["table", "key"]), "buckets")

    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= 2
    small = hits.where(F.col("n") <= pairwise).groupBy("table", "key").agg(F.collect_list("fp").alias("all"))
    small = small.select("all", F.explode("all").alias("u"))
    small = small.select("u", F.explode(F.filter("all", lambda v: (v > F.col("u")) & near(v, F.col("u")))).alias("v"))

    other = F.when(F.col("table") == -1, high).otherwise(low)
    two = [clear(F.col("other"), i, j) for i in range(32) for j in range(i)]
    one = [clear(F.col("other"), i) for i in range(32)]
    large = hits.where(F.col("n") > pairwise).withColumn("other", other)
    balls = F.when(F.col("table") < 0, F.array(*two)).otherwise(F.array(*one))
    large = large.select("table", "key", "fp", F.posexplode(balls).alias("ball", "rest"))
    heads = large.groupBy("table", "key", "ball", "rest").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("m"))
    large = large.join(heads.where("m > 1").hint("merge"), ["table", "key", "ball", "rest"]).select("u", F.col("fp").alias("v"))
    return small.unionByName(large.where((F.col("u") != F.col("v")) & near(F.col("u"), F.col("v"))))


def _placed(ws: Workspace, all_fps: DataFrame, order: Column, pairwise: int) -> DataFrame:
    """(fp, least): the least ``order`` of the rows that links reach from each fingerprint."""
    nodes = ws.save(all_fps.groupBy("fp").agg(F.min(order).alias("first")), "nodes")
    roots = connected_components(ws, links(ws, nodes.select("fp"), pairwise))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    return ws.save(placed.join(least, "root").select("fp", "least"), "placed")


def near_duplicates(docs: DataFrame, words: int = 3, pairwise: int = PAIRWISE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Fingerprints within 2 bits link; component_id is the smallest doc_id that links reach. Texts without words share the
    fingerprint zero, linked like any other; so do null texts. Repeated rows are rows of their own with one component. A null
    doc_id counts as larger than any other, so that a component of null doc_ids alone has none. Texts of any length are
    read whole. Other columns are passed over, whatever their names. An empty table gives an empty result. Copies share a
    fingerprint and are one node, so that a group of copies costs no pairs.
    """
    ws = Workspace(docs.sparkSession)
    all_fps = ws.save(fingerprints(docs, words), "fingerprints")
    placed = _placed(ws, all_fps, F.col("doc_id"), pairwise).withColumnRenamed("least", "component_id")
    return all_fps.join(placed, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, ws: Workspace, rows: DataFrame) -> DataFrame:
    """The documents without those that stand behind the first row of their group, or repeat it.

    ``rows`` are (doc_id, t1, t2, least) of every row, told apart by doc_id and text; least is a struct of the same three of
    the group's first row. Of rows alike in doc_id and text that are first, one stays, whichever it is.
    """
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("t1") == F.col("least.t1")) & (F.col("t2") == F.col("least.t2"))
    keys = rows.select("doc_id", "t1", "t2", first.alias("first")).groupBy("doc_id", "t1", "t2", "first").agg(F.count(F.lit(1)).alias("n"))
    rows = ws.save(keys.where("NOT first OR n > 1").drop("n"), "repeated")
    kept, twice = join_rows(docs, rows.where("NOT first"), "left_anti"), rows.where("first")
    if twice.isEmpty():
        return kept
    key = free_name(docs, "row")
    again = join_rows(kept, twice, "left_semi").withColumn(key, F.struct("doc_id", *row_key())).dropDuplicates([key]).drop(key)
    return join_rows(kept, twice, "left_anti").unionByName(again)


def one_of_each(docs: DataFrame, words: int = 3, pairwise: int = PAIRWISE) -> DataFrame:
    """The documents, with all their columns, of which one row of each group of ``near_duplicates`` stays.

    A group's place is taken by the row of its smallest doc_id, null behind all others, and of the smallest hash among those.
    """
    ws = Workspace(docs.sparkSession)
    rows = ws.save(fingerprints(docs, words, keyed=True), "fingerprints")
    placed = _placed(ws, rows, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2"), pairwise)
    return keep_first(docs, ws, rows.join(placed, "fp").select("doc_id", "t1", "t2", "least"))


def op2_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
