"""Incremental maintenance as Structured Streaming: event dedup, newest-wins replay, frequency counts and journal digests.

Sinks are idempotent by batch: each micro-batch writes its own folder, named by its number, so that a batch run again after a
lost driver overwrites what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import latest_by


def file_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def deduplicated(events: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each event key once; state of keys older than the watermark is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all that is available now, in micro-batches, and end."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(target: str) -> Callable[[DataFrame, int], None]:
    """All rows of a batch, in the batch's own folder."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return each


def newest_wins(target: str, key: str, *order: str) -> Callable[[DataFrame, int], None]:
    """Keep the newest event of each key of a batch. ``current`` folds the batches."""

    def each(batch: DataFrame, number: int) -> None:
        latest_by(batch, key, *(F.desc(c) for c in order)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return each


def current(spark: SparkSession, target: str, key: str, *order: str) -> DataFrame:
    """The newest row of each key over all batches. Deletes, if there is a column operation, are left out."""
    rows = latest_by(spark.read.parquet(target), key, *(F.desc(c) for c in order)).drop("batch")
    return rows.where("operation <> 'delete'") if "operation" in rows.columns else rows


def frequency_deltas(target: str, group: list[str]) -> Callable[[DataFrame, int], None]:
    """Signed counts of a batch: a column delta of 1 for what came and -1 for what went."""

    def each(batch: DataFrame, number: int) -> None:
        batch.groupBy(*group).agg(F.sum("delta").alias("delta")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return each


def frequencies(spark: SparkSession, target: str, group: list[str]) -> DataFrame:
    return spark.read.parquet(target).groupBy(*group).agg(F.sum("delta").alias("n")).where("n > 0")


def windowed_counts(events: DataFrame, time: str, size: str, slide: str | None, *group: str, delay: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums of value in event-time windows, late events dropped after ``delay``."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, delay).groupBy(w.alias("w"), *group).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, gap: str, *group: str, delay: str = "10 minutes") -> DataFrame:
    """Extension: sessions that end after a gap."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *group).agg(F.count(F.lit(1)).alias("n"))
