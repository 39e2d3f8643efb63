"""Operator 10: exact deduplication by progressive refinement (length, prefix hash, full hash)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import SPACE_CLASS, broadcast_if_small, text_code, without, written

#: Runs of white space other than one space: what normalising changes (single spaces, the most of all, stay as they are).
_UNEVEN = rf"[\x09-\x0D]{SPACE_CLASS}*| {SPACE_CLASS}+"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN, " ")


def full_hash(text: Column) -> Column:
    """SHA-256 of the normalised text in lowercase hex."""
    return F.sha2(normalised(text).cast("binary"), 256)


def alike(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = 96) -> DataFrame:
    """(_lf_key, _lf_code) of the rows whose length and then hash of the first ``prefix`` characters repeat; each pair once.

    One pass over the texts writes four numbers a row; both refinements are made on them. Counts are summed before every
    shuffle, so a huge group of copies is one row a task.
    """
    body = normalised(F.col(text))
    rows = docs.select(F.col(key).alias("_lf_key"), text_code(F.col(text)).alias("_lf_code"), body.alias("_lf_body"))
    rows = written(rows.select("_lf_key", "_lf_code", F.length("_lf_body").alias("_lf_length"), F.xxhash64(F.substring("_lf_body", 1, prefix)).alias("_lf_prefix")), "sizes")
    lengths = written(rows.groupBy("_lf_length").agg(F.count("*").alias("n")).where("n > 1").select("_lf_length"), "lengths")
    close = rows.join(broadcast_if_small(lengths), "_lf_length", "left_semi")
    prefixes = written(close.groupBy("_lf_length", "_lf_prefix").agg(F.count("*").alias("n")).where("n > 1").select("_lf_length", "_lf_prefix"), "prefixes")
    return written(rows.join(broadcast_if_small(prefixes), ["_lf_length", "_lf_prefix"], "left_semi").select("_lf_key", "_lf_code").distinct(), "alike")


def _pairs(rows: DataFrame, few: DataFrame) -> Column:
    return rows["_lf_key"].eqNullSafe(few["_k"]) & (rows["_lf_code"] == few["_c"])


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: Sequence[Column] = (), prefix: int = 96) -> DataFrame:
    """One row a document, dropped ones too: key, keep_id, group_size, kept, text_sha256 and ``extra`` columns.

    Of equal texts (after white-space normalisation, null as empty) the row with the least key stays; null keys come
    last. If the least key stands on several equal rows, one of them stays. Groups are formed by full hash among the
    rows that ``alike`` leaves; the hashes of all rows are in the result, so they are written once, beside the key.
    Whole texts never leave their scans. An empty table gives an empty result; other columns are not looked at.
    """
    few = alike(docs, key, text, prefix).select(F.col("_lf_key").alias("_k"), F.col("_lf_code").alias("_c"))
    hashed = written(docs.select(F.col(key).alias("_lf_key"), text_code(F.col(text)).alias("_lf_code"), full_hash(F.col(text)).alias("_lf_full"), *extra), "hashes")
    more = [c for c in hashed.columns if c not in ("_lf_key", "_lf_code", "_lf_full")]
    close = hashed.join(broadcast_if_small(few), _pairs(hashed, few), "left_semi")
    groups = close.groupBy("_lf_full").agg(F.min("_lf_key").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = written(groups.withColumnRenamed("_lf_full", "_f"), "copies")
    found = hashed.join(broadcast_if_small(groups), hashed["_lf_full"] == groups["_f"], "left")
    found = found.select(F.col("_lf_key").alias(key), "keep_id", "group_size", F.col("_lf_full").alias("text_sha256"), *more)
    single = found.where("group_size is null").withColumns({"keep_id": F.col(key), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    # numbered by (hash, key), and dealt by both: a group of any size is spread over its keys, and the join above, which
    # is dealt by hash alone, has nothing after it in its stage that would keep Spark from splitting a large group
    again = F.row_number().over(Window.partitionBy("text_sha256", key).orderBy(F.lit(0)))
    copies = found.where("group_size is not null").repartition("text_sha256", key).withColumn("kept", F.col(key).eqNullSafe(F.col("keep_id")) & (again == 1))
    columns = [key, "keep_id", "group_size", "kept", "text_sha256", *more]
    return single.select(columns).unionByName(copies.select(columns))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = 96) -> DataFrame:
    """``docs`` without its exact copies, all columns kept: of equal texts one row with the least key stays, null keys last.

    Only rows that ``alike`` leaves are read in full, as long as their counted number can be broadcast; beyond, all are
    hashed where they stand, which is cheaper than to shuffle their texts. What goes is told by key and text code.
    """
    few = alike(docs, key, text, prefix).select(F.col("_lf_key").alias("_k"), F.col("_lf_code").alias("_c"))
    rows = docs.select(F.col(key).alias("_lf_key"), text_code(F.col(text)).alias("_lf_code"), F.col(text).alias("_lf_text"))
    small = few.limit(200_001).count() <= 200_000
    read = rows.join(F.broadcast(few), _pairs(rows, few), "left_semi") if small else rows
    hashed = written(read.select("_lf_key", "_lf_code", full_hash(F.col("_lf_text")).alias("_lf_full")), "hashes")
    place = F.struct(F.col("_lf_key").isNull().alias("last"), F.col("_lf_key").alias("key"), F.col("_lf_code").alias("code"))
    close = hashed if small else hashed.join(few, _pairs(hashed, few), "left_semi")
    pairs = close.groupBy("_lf_full", "_lf_key", "_lf_code").agg(F.count("*").alias("n"))
    pairs = written(pairs, "pairs")
    firsts = written(pairs.groupBy(F.col("_lf_full").alias("_f")).agg(F.min(place).alias("first"), F.sum("n").alias("size")).where("size > 1"), "firsts")
    told = pairs.join(broadcast_if_small(firsts), pairs["_lf_full"] == firsts["_f"])
    stays = F.col("_lf_key").eqNullSafe(F.col("first.key")) & (F.col("_lf_code") == F.col("first.code"))
    told = written(told.select("_lf_key", "_lf_code", stays.alias("stays"), "n").where("not stays or n > 1"), "dropped")
    return without(docs, told, key, text)
