"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", binary: bool = False) -> DataFrame:
    """Only (doc_id, text): other columns, whatever they are called, never clash with an operator's own."""
    body = F.col(text).cast("string")
    return docs.select(F.col(doc_id).alias("doc_id"), (body.cast("binary") if binary else body).alias("text"))


def row_key() -> list[Column]:
    """128 bits of a text, to tell rows apart that repeat a doc_id."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), F.col("text")).alias("t2")]


def bucket_of(column: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


#: Rows of a file of an intermediate table whose size is known beforehand.
FILE_ROWS = 200_000


class Workspace:
    """Intermediate tables as Parquet in the folder that driver and executors share.

    A table written here has no lineage, so that a lost executor costs only the tasks it ran. The folder is that of
    ``spark.checkpoint.dir``. Where the session has none, a local master (tests) gets a temporary one, and a cluster an error:
    its executors would not see a folder of the driver's.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            root = spark.sparkContext._jsc.sc().getCheckpointDir()
            if root.isDefined():
                root = root.get()
            elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                root = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
                spark.sparkContext.setCheckpointDir(root)
            else:
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        self.root = f"{root.rstrip('/')}/{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write a table and read it back. ``rows``, if known, bounds its rows: few rows then make few files."""
        path = f"{self.root}/{name}"
        if rows is not None:
            df = df.coalesce(1 + rows // FILE_ROWS)
        df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read any more, and let Spark drop the shuffle files behind them.

        Spark deletes shuffle files when the driver's JVM collects the plans that made them; without the call below that may
        be long after a run of large rounds has filled the disks.
        """
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()


def ranked(df: DataFrame, group: str, order: Iterable[Column], salts: int, salt_by: Iterable[str], out: str) -> DataFrame:
    """Add ``out``: a gapless rank from 0 within each ``group``, without bringing a group into one task.

    Rows are dealt by (group, salt) and ranked there; the counts of the salts before give each salt's offset. The table of
    counts has at most ``salts`` rows a group. It is joined by key, so that its size needs no bound.
    """
    from pyspark.sql import Window as W

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    counts = salted.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = W.partitionBy(group, "_salt").orderBy(*order)
    return (
        salted.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [group, "_salt"])
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_salt", "_local", "_before")
    )


#: Rows of keys (doc_id and 128 bits of the text, about 60 bytes each in memory) that are broadcast at most.
BROADCAST_KEYS = 500_000


def free_name(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that no column of the table has."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (f"_{name}" + "_" * i for i in range(len(taken) + 1)) if n.lower() not in taken)


def join_rows(docs: DataFrame, keys: DataFrame, how: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """Semi- or anti-join documents to the rows of ``keys`` (doc_id, t1, t2, see ``row_key``), null doc_ids included.

    ``keys`` is a written table. It is broadcast if it has at most ``most`` rows, so that no text is shuffled; a larger one is
    joined in a shuffle.
    """
    body, own = F.col("text").cast("string"), [free_name(docs, c) for c in ("d", "t1", "t2")]
    rows = docs.withColumns(dict(zip(own, (F.col("doc_id"), F.xxhash64(body), F.xxhash64(F.lit("second"), body)))))
    keys = keys.select(*(F.col(c).alias(f"{n}of_key") for c, n in zip(("doc_id", "t1", "t2"), own)))
    if keys.limit(most + 1).count() <= most:
        keys = F.broadcast(keys)
    same = F.lit(True)
    for n in own:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}of_key"))
    return rows.join(keys, same, how).select(*(F.col(f"`{c}`") for c in docs.columns))
