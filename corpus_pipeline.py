"""The corpus pipeline: documents in, packed training sequences out. Counted as part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from korpusgraf.llm import langid, mixing, packing, secrets, simhash
from korpusgraf.llm.common import small_batches, stored, table


#: A document stays if its best language is at least as likely as all others together.
LIKELY = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learnt language; what has no letters, or no language of a probability of LIKELY, goes."""
    return langid.accepted(docs, LIKELY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with secrets masked."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes."""
    return mixing.resample(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequence and offset."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mixing", source_mixing), ("packing", packing_stage)]
#: Trained predictions and seeded draws are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with small_batches(docs):  # whole texts go through Python in bounded batches when the stage is written
            docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
