"""Nested folds, components of embeddings, and early stopping."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import evaluation, models, splits


def test_nested_folds(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"g{i % 40}") for i in range(900)]
    df = splits.nested_folds(spark.createDataFrame(rows, "id long, g string"), "g").collect()
    assert sorted(r.id for r in df) == list(range(900)) and all(r.roles.count("test") == 1 for r in df)
    for k in range(5):
        side = collections.defaultdict(set)
        for r in df:
            side[r.g].add(r.roles[k])
        assert all(len(s) == 1 for s in side.values())
        n = collections.Counter(r.roles[k] for r in df)
        assert n["test"] > 90 and n["train"] > n["validation"] > 0
    assert splits.nested_folds(spark.createDataFrame([], "id long, g string"), "g").count() == 0


def test_each_round_knows_its_training_rows_only(spark):
    df = spark.range(600).select("id", (F.col("id") % 23).alias("g"), (F.col("id") % 23 * 10.0).alias("x"), (F.col("id") % 2).cast("int").alias("label"))
    sides = []

    def learn(train, validation, test):
        assert not train.select("g").intersect(test.select("g")).count() and not train.select("g").intersect(validation.select("g")).count()
        m = train.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
        sides.append((round(m.m, 9), round(m.s, 9)))
        return test.withColumn("score", F.lit(0.5))

    found = evaluation.nested_out_of_fold(df, {"a": learn}, "g", ["x"]).collect()
    assert sides == [(0.0, 1.0)] * 5 and sorted(r.id for r in found) == list(range(600)) and {r.round for r in found} == set(range(5))


@pytest.mark.parametrize(("n", "width"), [(300, 8), (5, 8), (1, 3)])
def test_components_are_numpys(spark, n, width):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, width)) * np.logspace(0, -4, width)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n, None)], "id long, e array<double>").repartition(40)
    values, vectors = models.svd_components(df, "e", 4)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert values == pytest.approx(s[:4], abs=1e-12, rel=1e-9)
    for own, want in zip(vectors, vt[:4], strict=True):
        want = want * np.sign(want[np.abs(want).argmax()])
        assert own == pytest.approx(want, abs=1e-9)
    rows = {r.id: r for r in models.projected(df, "e", vectors).collect()}
    assert rows[n].component_0 is None
    for i in range(n):
        assert [rows[i][f"component_{k}"] for k in range(len(vectors))] == pytest.approx((x[i] @ vectors.T).tolist(), abs=1e-9)
    empty = models.svd_components(df.where("e is null"), "e")
    assert len(empty[0]) == 0 and models.truncated_svd(df.where("e is null"), "e").count() == 0


def test_trees_use_components_and_stop_early(spark):
    rng = np.random.default_rng(4)
    made = [(i, 0.0, (rng.normal(size=6) + (i % 2) * np.array([3, 0, 0, 0, 0, 0.0])).tolist() if i % 10 else None, i % 2) for i in range(400)]
    df = spark.createDataFrame(made, "id long, x double, e array<double>, label int")
    train, validation, test = (df.where(w) for w in ("id % 20 < 8", "id % 20 between 8 and 11", "id % 20 > 11"))
    scored = models.boosted_with_components(train, test, ["x"], "e", k=2, rounds=8, validation=validation)
    assert scored.columns[:4] == test.columns and "_svd_0" not in scored.columns
    right = scored.where("e is not null").select(((F.col("score") > 0.5).cast("int") == F.col("label")).alias("ok")).collect()
    assert sum(r.ok for r in right) > 0.8 * len(right)
