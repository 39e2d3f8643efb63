"""Positions in ranges and the dictionaries made of them."""

import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import aggregates, ranks, splits


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_positions_of_hot_and_equal_values(spark, many_ranges):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([1.5, 1.5, 1.5, -2.0, None, 7.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    first = lambda v: (v is not None, v or 0)
    got = {r.id: r.n for r in ranks.positions(df, ["g"], [F.col("x"), F.col("id")], "n").collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (first(r[2]), r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
    whole = {r.id: r.n for r in ranks.positions(df, [], [F.col("g"), F.desc("id")], "n").collect()}
    assert [whole[r[0]] for r in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or ""), -r[0]))] == list(range(1, 3001))
    assert ranks.positions(df.limit(0), [], [F.col("x")], "n").count() == 0


def test_dictionary_and_its_use(spark, many_ranges):
    words = [f"w{(i * 7919) % 500}é" for i in range(2000)] + [None, "", "Z"]
    df = spark.createDataFrame(list(enumerate(words)), "id long, w string")
    want = {w: i for i, w in enumerate(sorted({w for w in words if w is not None}, key=str.encode))}
    ids = ranks.dictionary(df, "w", "n")
    assert {r.w: r.n for r in ids.collect()} == want
    assert {r.id: r.n for r in aggregates.ordinal(df, "w", "n").collect()} == {i: want.get(w) for i, w in enumerate(words)}
    part = ids.where("w <> 'Z'")
    assert [r.n for r in aggregates.ordinal(df, "w", "n", part, "keep").where("w is null or w = 'Z'").collect()] == [-1, -1]
    assert aggregates.ordinal(df, "w", "n", part, "skip").count() == 2001
    with pytest.raises(Exception, match="unknown value"):
        aggregates.ordinal(df, "w", "n", part).collect()
    with pytest.raises(ValueError, match="error, keep or skip"):
        aggregates.ordinal(df, "w", "n", part, "other")


def test_no_day_is_one_task(spark, many_ranges):
    """All times unreadable: the order is that of the keys, cut at exact shares, from several sorted partitions."""
    df = spark.range(4000).select("id", F.lit(None).cast("timestamp").alias("t"))
    cut = splits.time_split(df, F.col("t"), "id")
    assert {r.split: (r.n, r.lo, r.hi) for r in cut.groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()} == {"train": (2800, 0, 2799), "validation": (400, 2800, 3199), "test": (800, 3200, 3999)}
    assert cut.select(F.spark_partition_id().alias("p")).distinct().count() > 2
