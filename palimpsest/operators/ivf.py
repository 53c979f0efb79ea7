"""An approximate index over vectors: a coarse quantiser and inverted lists.

Centroids are fitted by k-means on a bounded sample; every row goes to the list of its nearest one. A query probes the lists of
its nearest centroids only, and what lies in them is ranked by exact distance. With as many probes as lists the result is that of a scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.scratch import folder
from .recall import QUERY_BLOCK, in_blocks, top, vector_candidates

#: Rows that centroids are fitted on, about, and lists at most: what the driver holds.
FIT_ROWS, MOST_LISTS = 20_000, 4_096


def _unit(rows: np.ndarray, metric: str) -> np.ndarray:
    """Rows as they are compared with centroids: by direction alone for cosine."""
    if metric != "cosine":
        return rows
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(rows: np.ndarray, lists: int, metric: str = "cosine", rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Centroids of ``lists`` clusters at most; a cluster that loses its rows begins anew at the row farthest from its centroid."""
    x, rng = _unit(rows, metric), np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)] if len(x) else x
    for _ in range(rounds if len(x) else 0):
        d = vectors.distances_to(x, c, "l2")
        near = d.argmin(axis=1)
        far = np.argsort(-d[np.arange(len(x)), near])
        for j in range(len(c)):
            own = x[near == j]
            c[j] = own.mean(axis=0) if len(own) else x[far[j % len(far)]]
        c = _unit(c, metric)
    return c


class InvertedLists:
    """Rows (list, id, vector) in files sorted by list, so that a probe reads the row groups of its lists; and the centroids."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, metric: str, probes: int):
        self.spark, self.path, self.centroids, self.metric, self.probes = spark, path, centroids, metric, probes

    @classmethod
    def build(cls, store: DataFrame, lists: int | None = None, metric: str = "cosine", probes: int | None = None, path: str | None = None, fit_rows: int = FIT_ROWS) -> InvertedLists:
        """Index every row of a store (id, vector). ``lists``: by default the square root of the rows.

        A hot list is divided over tasks and files like any other: rows are dealt by ranges of list and id.
        """
        spark, path, n = store.sparkSession, path or folder(store.sparkSession), store.count()
        lists = min(MOST_LISTS, lists or max(1, round(n**0.5)))
        share = min(1.0, 1.2 * fit_rows / max(1, n))
        place = F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 11) / F.lit(float(1 << 53))
        sample = store.where(place < share).orderBy(place).limit(fit_rows).select("vector").toArrow()["vector"].to_pylist()
        centroids = fit(np.array(sample, dtype=np.float64).reshape(len(sample), -1 if sample else 0), lists, metric)

        def run(batches):
            for b in batches:
                own = np.array(b.column("vector").to_pylist(), dtype=np.float64).reshape(b.num_rows, -1 if b.num_rows else 0)
                near = vectors.distances_to(_unit(own, metric), centroids, "l2").argmin(axis=1) if b.num_rows and len(centroids) else np.zeros(b.num_rows, int)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column("id"), b.column("vector")], ["list", "id", "vector"])

        rows = store.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        rows = rows.mapInArrow(run, "list int, id string, vector array<double>")
        rows.repartitionByRange("list", "id").sortWithinPartitions("list").write.mode("overwrite").parquet(path)
        return cls(spark, path, centroids, metric, probes or max(1, len(centroids) // 8))

    def rows(self) -> DataFrame:
        return self.spark.read.schema("list int, id string, vector array<double>").parquet(self.path)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, without: DataFrame | None = None, most: int | None = QUERY_BLOCK) -> DataFrame:
        """(query_id, id, distance, rank): about the ``k`` nearest of each query (query_id, vector), of the rows not in ``without`` (id).

        A block of queries goes to the rows of the lists that any of them probes; each row meets the queries of its own list.
        """
        probes = min(len(self.centroids), probes or self.probes)
        centroids, metric = self.centroids, self.metric

        def block(asked: DataFrame) -> DataFrame:
            got = asked.select(F.col("query_id").cast("string"), "vector").orderBy("query_id").collect()  # one block
            ids, given = [r[0] for r in got], np.array([r[1] for r in got], dtype=np.float64).reshape(len(got), -1 if got else 0)
            probed = np.argsort(vectors.distances_to(_unit(given, metric), centroids, "l2"), axis=1, kind="stable")[:, :probes] if len(got) and probes else np.zeros((len(got), 0), int)
            of_list = {int(c): np.flatnonzero((probed == c).any(axis=1)) for c in np.unique(probed)}

            def run(batches):
                for b in batches:
                    lists, out = b.column("list").to_numpy(), []
                    own = np.array(b.column("vector").to_pylist(), dtype=np.float64).reshape(b.num_rows, -1 if b.num_rows else 0)
                    for c in np.unique(lists):
                        here, q = np.flatnonzero(lists == c), of_list.get(int(c), ())
                        if len(q) == 0:
                            continue
                        d = np.round(vectors.distances_to(own[here], given[q], metric), 6)
                        for j in range(len(q)):
                            limit = np.partition(d[:, j], k - 1)[k - 1] if len(here) > k else np.inf
                            keep = np.flatnonzero(d[:, j] <= limit)
                            out += zip([ids[q[j]]] * len(keep), here[keep], d[keep, j])
                    query, place, distance = zip(*out) if out else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(query, pa.string()), b.column("id").take(pa.array(place, pa.int64())), pa.array(distance, pa.float64())], ["query_id", "id", "distance"])

            rows = self.rows().where(F.col("list").isin(sorted(of_list)) if of_list else F.lit(False))
            if without is not None:
                rows = rows.join(without.select("id"), "id", "left_anti").select("list", "id", "vector")
            return top(rows.mapInArrow(run, "query_id string, id string, distance double"), "query_id", k, F.col("distance"), F.col("id"))

        return in_blocks(queries, block, most)

    def recall(self, queries: DataFrame, k: int, probes: int | None = None, exact: DataFrame | None = None) -> float:
        """The share of the ``k`` nearest by a scan that a search finds."""
        exact = exact if exact is not None else vector_candidates(self.rows(), queries, k, self.metric)
        hit = exact.join(self.search(queries, k, probes).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
        return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 1.0

    def tuned(self, queries: DataFrame, k: int, least: float = 0.9) -> InvertedLists:
        """The same index with the fewest probes, doubling from one, that reach a recall on these queries."""
        from ..sources.scratch import written

        exact, probes = written(vector_candidates(self.rows(), queries, k, self.metric)), 1
        while probes < len(self.centroids) and self.recall(queries, k, probes, exact) < least:
            probes = min(len(self.centroids), 2 * probes)
        return InvertedLists(self.spark, self.path, self.centroids, self.metric, probes)
