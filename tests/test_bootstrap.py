"""Bootstrap intervals with their estimates, and the registered sizes of the jobs."""

import pytest
from pyspark.sql import functions as F

from locusframe.operators import metrics, models
from locusframe.plans import queries as plans

SCHEMA = "key bigint, score double, label int"


def test_interval_has_estimates(spark):
    rows = spark.createDataFrame([(i, (i * 37 % 101) / 101, int(i * 53 % 7 < 3 or i % 101 > 80)) for i in range(300)], SCHEMA)
    got, point = metrics.bootstrap_interval(rows).first(), metrics.ranking(rows).first()
    assert got.auc == pytest.approx(point.auc, abs=1e-12) and got.ap == pytest.approx(point.ap, abs=1e-12)
    assert got.auc_low < got.auc < got.auc_high and got.ap_low < got.ap < got.ap_high
    for some in (rows.where("label = 1"), rows.limit(0)):
        assert tuple(metrics.bootstrap_interval(some).first()) == (0.5, 0.0, 0.5, 0.5, 0.0, 0.0)
    assert len(metrics._poisson_steps(1)) > 12 and len(metrics._poisson_steps(30)) > 60


def test_many_rows_of_a_score_are_drawn_together(spark):
    """Intervals from a few scores with many rows each are those of the rows drawn one by one, as wide as theory says."""
    rows = spark.range(20_000).select((F.col("id") % 2).cast("double").alias("score"), (F.col("id") % 10 < F.when(F.col("id") % 2 == 1, 7).otherwise(3)).cast("int").alias("label"))
    r = metrics.bootstrap_interval(rows).first()
    assert r.auc_low < r.auc < r.auc_high and 0.008 < r.auc_high - r.auc_low < 0.02


def test_registered_rounds_and_replicates(spark, monkeypatch):
    asked = {}

    class Stop(Exception):
        pass

    class Trees:
        def __init__(self, **given):
            asked.update(given)
            raise Stop

    monkeypatch.setattr(models, "GBTClassifier", Trees)
    try:
        plans.QUERIES["gbt"](spark, "/root/testdata/sf0.001")
    except Stop:
        pass
    assert asked["maxIter"] == 100
    assert metrics.bootstrap_interval.__defaults__[2] == 200


def plain_intervals(rows, replicates, seed):
    """Replicates one by one from the same draws: scores, weights, areas and precisions in plain Python."""
    import numpy as np

    scores = sorted({s for s, _ in rows})
    counts = {(s, l): sum(r == (s, l) for r in rows) for s in scores for l in (0, 1)}
    draws = {l: metrics._weights(np.array(scores), l, np.array([counts[s, l] for s in scores]), replicates, seed) for l in (0, 1)}
    out = []
    for r in range(1 + replicates):
        p, q = draws[1][:, r], draws[0][:, r]
        if not p.sum() or not q.sum():
            continue
        auc = sum(p[i] * (q[:i].sum() + q[i] / 2) for i in range(len(scores))) / (p.sum() * q.sum())
        ap = sum(p[i] * p[i:].sum() / (p[i:].sum() + q[i:].sum()) for i in range(len(scores)) if p[i:].sum() + q[i:].sum()) / p.sum()
        out.append((auc, ap))
    at = lambda k, f: np.percentile([x[k] for x in out[1:]], f)
    return (*out[0], at(0, 2.5), at(0, 97.5), at(1, 2.5), at(1, 97.5))


def test_groups_are_measured_in_one_plan(spark):
    """Several groups over several ranges: each equal to its own replicates, and to the same rows measured alone."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(g, round((i * 37 % (11 + 90 * n)) / 101, 3), int(i * 53 % 7 < 3 + n)) for n, g in enumerate(["a", "b", None]) for i in range(260)] + [("one class", 0.5, 1), ("one class", 0.6, 1), ("a", None, 1)]
        df = spark.createDataFrame(rows, "g string, score double, label int")
        got = {r.g: tuple(r)[1:] for r in metrics.bootstrap_intervals(df, ["g"], replicates=40).collect()}
        assert got["one class"] == (0.5, 0.0, 0.5, 0.5, 0.0, 0.0) and len(got) == 4
        for g in ("a", "b", None):
            want = plain_intervals([(s, l) for k, s, l in rows if k == g and s is not None], 40, 7)
            alone = tuple(metrics.bootstrap_interval(df.where(F.col("g").eqNullSafe(g)), replicates=40).first())
            assert got[g] == pytest.approx(want, abs=1e-12) and alone == pytest.approx(want, abs=1e-12)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_draws_are_those_of_sparks_hash(spark):
    import numpy as np

    scores = [0.0, -0.0, 0.25, -7.5, 1e300]
    made = [(s, l, at, r) for s in scores for l in (0, 1) for at in (0, 3) for r in (1, 200)]
    told = spark.createDataFrame(made, "s double, l int, at int, r int").select("*", F.xxhash64("s", "l", "at", "r", F.lit(7)).alias("h")).collect()
    with np.errstate(over="ignore"):
        for x in told:
            h = metrics._hash_int(np.array([x.at]), metrics._hash_int(np.array([x.l]), metrics._hash_double(np.array([x.s]), np.uint64(42))))
            h = metrics._hash_int(np.array([7]), metrics._hash_int(np.array([x.r]), h))
            assert int(h[0].astype(np.int64)) == x.h
