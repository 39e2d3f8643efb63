"""Operator 1: weighted rendezvous sharding of stable record keys, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of an MD5 that make a uniform number (52 bits, exact in a double).
_DIGITS = 13


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) decided by ``parts`` alone."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of ``key``.

    Every shard draws the score -weight / ln(u), u uniform from the key and the shard's number; the highest wins. A
    shard gets keys in proportion to its weight, and a new or heavier shard only takes keys into itself. A null key
    is treated as the text 'null'; weights must be positive. Equal scores (about 2^-52 a pair) go to the higher shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and not empty")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    sizes = F.array(*[F.lit(float(w)) for w in weights])
    score = lambda i: -F.get(sizes, i) / F.ln(_uniform(text, i.cast("string")))
    scores = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda i: F.struct(score(i).alias("score"), i.alias("shard")))
    return F.array_max(scores).getField("shard")


def with_slots(assigned: DataFrame, shard: str, key: str, slot: str = "slot", blocks: int = 256) -> DataFrame:
    """Adds ``slot``: positions without gaps from 0 in each shard.

    A shard is numbered in ``blocks`` hash blocks at once: rows are counted a block (key column only), the counts are
    summed to block starts, and rows are numbered inside their block by key. No task holds a shard; raise ``blocks``
    with the table. Repeated keys get different slots in an unspecified order.
    """
    block = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(blocks))
    placed = assigned.withColumn("_lf_block", block)
    starts = placed.groupBy(shard, "_lf_block").agg(F.count("*").alias("_lf_n"))
    before = Window.partitionBy(shard).orderBy("_lf_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(shard, "_lf_block", F.coalesce(F.sum("_lf_n").over(before), F.lit(0)).alias("_lf_start"))
    numbered = placed.withColumn("_lf_at", F.row_number().over(Window.partitionBy(shard, "_lf_block").orderBy(key)))
    # at most shards x blocks rows: a bound set by the parameters, whatever the table's size
    joined = numbered.join(F.broadcast(starts), [shard, "_lf_block"])
    return joined.withColumn(slot, F.col("_lf_start") + F.col("_lf_at") - 1).drop("_lf_block", "_lf_at", "_lf_start")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float], key: str = "doc_id", text: str = "text", blocks: int = 256) -> DataFrame:
    """One row a record: key, size (UTF-8 bytes + 1), text_crc32, law ('key'), shard, slot and grown_shard.

    Nulls: a null text has no bytes (size 1, crc32 0), a null key is the key 'null'. Repeated rows share a shard and
    get slots of their own. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col(key), weights).alias("shard"),
        rendezvous_shard(F.col(key), grown_weights).alias("grown_shard"),
    )
    return with_slots(rows, "shard", key, blocks=blocks).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
