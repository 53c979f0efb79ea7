"""Vector stores: a protocol, and one that keeps its batches as Parquet in a shared folder."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import folder


class VectorStore(Protocol):
    """Rows (id, scope_id, vector, updated_at) by id. Any table that Spark can read and write may stand behind it."""

    def read(self, scopes: list[str] | None = None) -> DataFrame: ...
    def upsert(self, rows: DataFrame) -> None: ...
    def delete(self, ids: DataFrame) -> None: ...
    def audit(self) -> DataFrame: ...


class FolderStore:
    """Batches of changes in numbered folders; what is read is the newest change of each id, without deletions.

    A batch is one write, so that a batch run again after a failure replaces itself. ``compact`` folds all batches into one.
    """

    SCHEMA = "id string, scope_id string, vector array<double>, updated_at timestamp_ntz, gone boolean"

    def __init__(self, spark: SparkSession, path: str, batches: int = 0):
        self.spark, self.path, self.batches = spark, path, batches

    @classmethod
    def new(cls, spark: SparkSession) -> FolderStore:
        return cls(spark, folder(spark))

    def _append(self, rows: DataFrame) -> None:
        kinds = dict(c.strip().split(" ", 1) for c in self.SCHEMA.split(", "))
        rows.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items())).write.mode("overwrite").parquet(f"{self.path}/batch={self.batches}")
        self.batches += 1

    def upsert(self, rows: DataFrame) -> None:
        self._append(rows.withColumn("gone", F.lit(False)))

    def delete(self, ids: DataFrame) -> None:
        none = F.lit(None)
        self._append(ids.select("id", none.alias("scope_id"), none.cast("array<double>").alias("vector"), none.alias("updated_at"), F.lit(True).alias("gone")))

    def physical(self) -> DataFrame:
        """Every change, with its batch."""
        return self.spark.read.schema(self.SCHEMA + ", batch int").parquet(self.path)

    def read(self, scopes: list[str] | None = None) -> DataFrame:
        names = ("scope_id", "vector", "updated_at", "gone")
        newest = self.physical().groupBy("id").agg(F.max_by(F.struct(*names), F.struct("batch", "updated_at")).alias("r"))
        rows = newest.select("id", *(f"r.{n}" for n in names)).where("NOT gone").drop("gone")
        return rows if scopes is None else rows.where(F.col("scope_id").isin(*scopes))

    def compact(self) -> FolderStore:
        """A store of one batch with the same rows."""
        out = FolderStore.new(self.spark)
        out.upsert(self.read())
        return out

    def audit(self) -> DataFrame:
        """One row: changes kept, ids among them, and changes that a newer one hides."""
        ids = F.countDistinct("id")
        return self.physical().agg(F.count(F.lit(1)).alias("physical"), ids.alias("unique_ids"), (F.count(F.lit(1)) - ids).alias("duplicates"))


class IndexedStore(FolderStore):
    """A folder store with an approximate index beside it.

    What changed after the index was built is searched as it is, and hides the index's rows of the same ids; ``build`` takes it in.
    """

    index = None
    indexed = 0

    def build(self, **settings) -> IndexedStore:
        from ..operators.ivf import InvertedLists

        self.index, self.indexed = InvertedLists.build(self.read().where("vector IS NOT NULL"), **settings), self.batches
        return self

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, distance, rank) of the rows nearest to each query (query_id, vector)."""
        from ..operators.recall import top, vector_candidates

        metric = self.index.metric if self.index else "cosine"
        if self.index is None:
            return vector_candidates(self.read().select("id", "vector"), queries, k, metric)
        if self.indexed == self.batches:
            return self.index.search(queries, k, probes)
        changed = self.physical().where(F.col("batch") >= self.indexed).select("id").distinct()
        fresh = self.read().join(changed, "id", "left_semi").select("id", "vector")
        both = self.index.search(queries, k, probes, changed).unionByName(vector_candidates(fresh, queries, k, metric))
        return top(both.drop("rank"), "query_id", k, F.col("distance"), F.col("id"))


#: Stores by name: functions of a session and settings. Others are added with ``STORES[name] = ...``.
STORES = {
    "folder": lambda spark, path=None: FolderStore(spark, path) if path else FolderStore.new(spark),
    "indexed": lambda spark, path=None: IndexedStore(spark, path) if path else IndexedStore.new(spark),
}


def store(spark: SparkSession, name: str = "folder", **settings) -> VectorStore:
    if name not in STORES:
        raise ValueError(f"no store {name}: {', '.join(sorted(STORES))}")
    return STORES[name](spark, **settings)
