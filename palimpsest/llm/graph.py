"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _both(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends, with a mark for its own direction."""
    ends = F.explode(F.array(F.struct("u", "v", F.lit(1).alias("own")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("own"))))
    return edges.select(ends.alias("e")).select("e.*")


def connected_components(ws: Workspace, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the smallest node of its component.

    Alternating large-star and small-star (Kiveris et al. 2014): each round hangs neighbours under the smallest one seen, so
    the edges never grow in number and about log(n) rounds suffice for long chains too. Each round is written to the shared
    folder. It is over when every edge is a ray of a star. Isolated nodes have no edge and so no row. No edges: an empty table.
    """
    now = ws.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-0")
    rows = now.count()
    for k in count(1):
        ends = _both(now).groupBy("u").agg(F.sum("own").alias("up"), F.count(F.lit(1)).alias("n"))
        # a ray's outer end has one edge, and that leads up; a centre's edges all come from below
        if ends.where("up > 0 AND n > 1").isEmpty():
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = _both(now).select("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # now every edge points from the larger to the smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = ws.save(small.select("e.*").where("u <> v").distinct(), f"{name}-{k}", rows)
        ws.drop(f"{name}-{k - 1}")
