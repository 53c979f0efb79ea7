"""Sharding by jump consistent hashing (Lamping and Veach 2014).

A key's shard follows from the key and the number of shards alone: no ring table, nothing to look up or broadcast. When
one shard is appended, a key either keeps its shard or goes to the new one, and about 1 / (n + 1) of the keys go.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, read_table, texts

#: Slots are counted in parts of a shard of about this many rows, and 64 parts at least.
PART_ROWS = 50_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash of unsigned 64-bit keys, for all keys at once."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), dtype=np.int64)
    ahead = np.zeros(len(key), dtype=np.int64)
    going = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(going):
            shard[going] = ahead[going]
            key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((key[going] >> np.uint64(33)).astype(np.float64) + 1.0)
            ahead[going] = ((shard[going] + 1) * step).astype(np.int64)
            going = going[ahead[going] < shards]
    return shard.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a bigint key column. A null key counts as 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return place(F.coalesce(key.cast("long"), F.lit(0)))


def shard_documents(docs: DataFrame, shards: int = 24, salts: int | None = None) -> DataFrame:
    """Deal documents to shards by doc_id.

    Returns doc_id, size (UTF-8 bytes plus 8; a null text has none), text_crc32, law ('key'), shard, slot (gapless from 0 in
    each shard) and grown_shard (the shard when there is one more). Equal doc_ids share a shard whatever their texts; since
    doc_id alone decides, equal texts of different doc_ids need not. A null doc_id counts as one key. Rows alike in doc_id, size and
    checksum take slots that follow one another, in any order among themselves. Texts of any length are reduced to size and
    checksum before anything is shuffled. Columns other than doc_id and text are passed over, whatever their names. An empty
    table gives an empty result.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = texts(docs).select(
        "doc_id",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    key = F.xxhash64(F.col("doc_id").cast("string"))
    rows = rows.withColumn("shard", jump_shard(key, shards)).withColumn("grown_shard", jump_shard(key, shards + 1))
    salts = salts or max(64, docs.count() // (shards * PART_ROWS))
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    placed = ranked(rows, "shard", order, salts, ["doc_id", "size", "text_crc32"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), 24)
