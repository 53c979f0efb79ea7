"""Corpus pipeline: filter, deduplicate, decontaminate, mask secrets and pack ``documents``.

Each stage works on all that the stage before it kept and returns the columns of ``documents``; the last returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import Workspace, read_table
from palimpsest.llm.decontaminate import clean
from palimpsest.llm.nearcopies import one_of_similar
from palimpsest.llm.packing import pack
from palimpsest.llm.quality import keep_good
from palimpsest.llm.secrets import mask_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on these documents' labels, does not reject."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose shingles of five words are 0.8 alike or more: the one of the smallest doc_id.

    Texts without words are one group. Rows are told apart by doc_id and text: those that repeat a doc_id, or have none, go
    or stay each with its own text's group.
    """
    return one_of_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in 20 lies in a benchmark window, each row by its own text."""
    return clean(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with ``[secret]`` in place of each secret; n_chars follows the text."""
    return mask_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("best-fit packing", packing),
]
#: Fingerprints, a fitted machine and tokens are beyond SQL: the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted when the next one has been written from it."""
    docs, ws = read_table(spark, sf_dir, "documents"), Workspace(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
