"""Files as tables and tables as files: curated notes, exports, imports and relational sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

DELIMITER = "§"


def curated_entries(spark: SparkSession, path: str, delimiter: str = DELIMITER) -> DataFrame:
    """(path, place, content): the entries of note files, divided by a delimiter."""
    notes = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    rows = notes.select("path", F.posexplode(F.split("value", delimiter)).alias("place", "content"))
    return rows.withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", "")).where("content <> ''")


def export(rows: DataFrame, path: str, form: str = "jsonl") -> None:
    """Write rows as JSON lines, Parquet, ORC or CSV: a file for each partition, never through the driver."""
    if form not in ("jsonl", "json", "parquet", "orc", "csv"):
        raise ValueError(f"no export to {form}")
    rows.write.mode("overwrite").format("json" if form == "jsonl" else form).save(path)


def export_contract(rows: DataFrame, policy: str = "keep_newest") -> DataFrame:
    """Rows with their provenance as one struct, for another store to take over."""
    return rows.select("id", "content", "target", F.struct("scope_id", "source", F.lit(policy).alias("conflict_policy"), F.sha2("content", 256).alias("content_hash")).alias("provenance"))


def fingerprinted(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with a fingerprint of the columns that make an import the same import."""
    return rows.withColumn("fingerprint", F.sha1(F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))))


def import_new(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """What a ledger of fingerprints has not seen; one row for each fingerprint."""
    return rows.dropDuplicates(["fingerprint"]).join(ledger.select("fingerprint"), "fingerprint", "left_anti")


#: Two lines or more that begin with who speaks.
TRANSCRIPT = r"(?im)(?:^\s*(?:user|assistant|system|human|tool)\s*[:：].*$[\s\S]*?){2,}"
TARGETS = ("user", "memory", "project", "ops", "general")


def import_plan(rows: DataFrame, ledger: DataFrame, prefix: str, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """What an import of foreign rows (id, text, scope, category, timestamp, metadata) would do, one row each.

    ``outcome`` is importable, or empty, target_not_allowed, raw_transcript, already_imported (``ledger`` (fingerprint) knows it) or
    repeated (an earlier row of the batch, by id, has its fingerprint). The mapped columns are those of a memory: id and
    fingerprint follow from scope, category, text, timestamp, metadata and id, the scope gets a prefix. ``findings`` name what
    looks like a secret or a private path in text or metadata; ``snippet`` is redacted, and so is what is shown of a
    rejected row. Nothing is written; a plan without rejections and findings is safe to apply.
    """
    content, scope = F.trim(F.coalesce("text", F.lit(""))), F.coalesce(F.nullif(F.trim("scope"), F.lit("")), F.lit("unknown"))
    target = F.coalesce(F.nullif(F.lower(F.trim("category")), F.lit("")), F.lit("memory"))
    both = F.concat_ws("\n", content, F.coalesce("metadata", F.lit("")))
    out = rows.select(F.col("id").cast("string").alias("row_id"), content.alias("content"), scope.alias("raw_scope"), target.alias("target"), F.col("timestamp").alias("updated_at"), F.coalesce("metadata", F.lit("")).alias("metadata"), both.alias("_both"))
    out = fingerprinted(out, "row_id", "raw_scope", "target", "content", "updated_at", "metadata")
    findings = F.array_compact(F.array(F.when(F.col("_both").rlike(text.SECRET), "secret_like"), F.when(F.col("_both").rlike(text.PRIVATE_PATH), "path_like")))
    known = ledger.select("fingerprint").distinct().withColumn("_known", F.lit(True))
    first = W.partitionBy("fingerprint").orderBy("row_id")
    out = out.join(known, "fingerprint", "left").withColumn("_turn", F.row_number().over(first))
    outcome = (
        F.when(F.col("content") == "", "empty").when(~F.col("target").isin(*targets), "target_not_allowed").when(F.col("content").rlike(TRANSCRIPT), "raw_transcript")
        .when(F.col("_known"), "already_imported").when(F.col("_turn") > 1, "repeated").otherwise("importable")
    )
    return out.select(
        "row_id", outcome.alias("outcome"), F.concat(F.lit("imported:"), "fingerprint").alias("id"), F.concat(F.lit(f"{prefix}|"), "raw_scope").alias("scope_id"), "target", "content",
        text.compact("content", 220).alias("summary"), "updated_at", "metadata", "fingerprint", findings.alias("findings"), text.sanitized(F.left("content", F.lit(160))).alias("snippet"),
    )


def to_jdbc(rows: DataFrame, url: str, table: str, driver: str | None = None, batch: int = 5_000) -> None:
    """Append to a staging table of a relational store. Needs its driver on the class path."""
    writer = rows.write.mode("append").option("batchsize", batch)
    (writer.option("driver", driver) if driver else writer).jdbc(url, table)
