"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.sources.cache import VersionedCache


def write_routed(rows: DataFrame, destination: Column, path: str) -> None:
    """One pass; each row goes to the folder of its destination."""
    rows.withColumn("dest", destination).write.partitionBy("dest").parquet(path)


def label_destination(label: Column, is_indel: Column) -> Column:
    return F.when(is_indel & label.isin(0, 1), "indel").when(label.isin(0, 1), "labelled").when(label == 2, "vus").otherwise("conflict")


def append_missing(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str], build) -> DataFrame | None:
    """A cache table: rows for keys that it lacks are built and committed, then its newest version is returned (``VersionedCache``)."""
    return VersionedCache(spark, path, keys).fill(wanted, build)


def write_features(features: DataFrame, path: str, form: str = "parquet") -> None:
    """The featured table, as Parquet or as CSV with a header."""
    writer = features.write.mode("errorifexists")
    writer.parquet(path) if form == "parquet" else writer.option("header", True).csv(path)


def write_score_cache(scores: DataFrame, path: str) -> None:
    """(gene, aa_pos, scores, embedding), a row a position; embeddings are stored in single precision."""
    scores.select("gene", "aa_pos", "scores", F.col("embedding").cast("array<float>").alias("embedding")).write.parquet(path)


def write_report_lines(lines: DataFrame, path: str, sample: str = "sample_id") -> None:
    """``report.report_lines`` as text: a folder a sample, whose files are read in order of their names."""
    dealt = lines.repartitionByRange(sample, "section", "number").sortWithinPartitions(sample, "section", "number")
    dealt.select(sample, F.col("line").alias("value")).write.partitionBy(sample).text(path)


def markdown_rows(metrics: DataFrame, columns: list[str]) -> DataFrame:
    return metrics.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |")).alias("value"))
