"""The corpus pipeline: stages in order, each over all that its predecessor kept.

Good documents by the byte-level network, one of each group of near duplicates,
personal data masked, sources mixed to target weights, then whole texts packed
into sequences. All stages but the last keep the columns of documents. Each
handles empty tables, nulls and extra columns as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparquill.llm import byte_cnn, mixing, near_duplicates, packing, pii


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return byte_cnn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.keep_one(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and n_chars counted anew."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents at the target weights."""
    return mixing.keep_sampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", one_of_each), ("personal_data", masked), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None  # no stage but the third could be expressed; tests hold run() against its stages' brute-force twins


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each reading what its predecessor wrote."""
    from sparquill.llm.common import Scratch

    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
