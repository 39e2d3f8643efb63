"""A document table made ready for training, in five stages; each is written as Parquet before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusframe.llm import exact_dedup, packing, quality_rules, simhash, substring_dedup
from locusframe.llm.common import shared_path, table
from locusframe.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the filter policy of the rule ledger keeps."""
    return quality_rules.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in earlier ones."""
    return substring_dedup.remove_passages(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 0)


STAGES = [("quality rules", quality), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies), ("substring dedup", passages), ("packing", packed)]

#: SimHash can't be told in SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each kept is in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
