"""The interval sweep against brute force."""

import collections
import random

import pytest

from locusframe.operators import intervals

POINT, SPAN = "id long, k string, chrom string, pos long", "gene string, chrom string, start long, end long"


def plain(points, spans):
    out = []
    for i, k, c, p in points:
        held = [g for g, c2, a, b in spans if g is not None and c is not None and c2 == c and a is not None and b is not None and p is not None and a <= p <= b]
        out.append((i, k, len(held), held[0] if len(held) == 1 else None))
    return collections.Counter(out)


@pytest.mark.parametrize("coalesce", ["true", "false"])
@pytest.mark.parametrize("seed", range(3))
def test_sweep(spark, seed, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        rng = random.Random(seed)
        place = lambda: rng.choice([rng.randrange(50), rng.randrange(100_000_000)])
        spans = [(rng.choice("abc"), rng.choice(["1", "2", "X"]), a := place(), a + rng.choice([0, 1, 10, 10_000, 100_000_000])) for _ in range(120)]
        spans += [spans[0], ("w", "1", 9, 3), (None, "1", 0, 10**9), ("n", None, 0, 10**9), ("m", "2", None, 5), ("q", "only here", 5, 5)]
        points = [(i, rng.choice("xy"), rng.choice(["1", "2", "X", "none", None]), rng.choice([place(), None, rng.choice(spans)[2]])) for i in range(600)] + [(7, "x", "1", 5)] * 40 + [(8, "x", "only here", 5)]
        got = intervals.interval_matches(spark.createDataFrame(points, POINT), spark.createDataFrame(spans, SPAN), ["id", "k"])
        assert collections.Counter(map(tuple, got.collect())) == plain(points, spans)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "explode" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nothing_on_one_side(spark):
    points, spans = spark.createDataFrame([(1, "x", "1", 5)], POINT), spark.createDataFrame([("g", "1", 1, 9)], SPAN)
    assert [tuple(r) for r in intervals.interval_matches(points, spans.limit(0), ["id"]).collect()] == [(1, 0, None)]
    assert intervals.interval_matches(points.limit(0), spans, ["id"]).count() == 0
