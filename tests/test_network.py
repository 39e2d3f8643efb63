"""The batched network against one row at a time in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import network
from locusframe.sources.shared import shared_path


def random_member(rng, tabular=5, classes=4, syndromes=3, embedding=7, hidden=12):
    layer = lambda out, width, even: {"w": rng.normal(size=(out, width)), "b": rng.normal(size=out)} | ({"g": rng.normal(size=even), "o": rng.normal(size=even)} if even else {})
    layers = {
        "tabular": layer(6, tabular, 6), "project": layer(4, embedding, 0), "mlp_in": layer(6, 6, 6), "mlp_out": layer(5, 6, 0), "fuse": layer(hidden, 6 + 2 + 2 + 5, hidden),
        **{f"block{i}.{p}": layer(hidden, hidden, hidden) for i in range(2) for p in ("first", "second")}, "head": layer(1, hidden, hidden),
    }
    return {f"{n}.{k}": v for n, x in layers.items() for k, v in x.items()} | {"classes": rng.normal(size=(classes, 2)), "syndromes": rng.normal(size=(syndromes, 2))}


def plain_logit(a, tabular, c, s, llr, available, embedding):
    product = lambda n, x: [sum(w * v for w, v in zip(row, x, strict=True)) + b for row, b in zip(a[f"{n}.w"].tolist(), a[f"{n}.b"].tolist(), strict=True)]
    act = lambda x: [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x]

    def even(n, x):
        m = sum(x) / len(x)
        d = math.sqrt(sum((v - m) ** 2 for v in x) / len(x) + 1e-5)
        return [(v - m) / d * g + o for v, g, o in zip(x, a[f"{n}.g"].tolist(), a[f"{n}.o"].tolist(), strict=True)]

    second = product("mlp_out", act(even("mlp_in", product("mlp_in", [llr, available, *product("project", embedding)]))))
    x = act(even("fuse", product("fuse", [*act(even("tabular", product("tabular", tabular))), *a["classes"][c], *a["syndromes"][s], *second])))
    for i in range(2):
        y = x
        for part in ("first", "second"):
            y = product(f"block{i}.{part}", act(even(f"block{i}.{part}", y)))
        x = [u + v for u, v in zip(x, y, strict=True)]
    return product("head", act(even("head", x)))[0]


def test_error_function():
    x = np.concatenate([np.linspace(-9, 9, 20_001), [0.0, -0.0, 6.0, -6.0]])
    assert np.abs(network.erf(x) - [math.erf(v) for v in x]).max() < 1e-13


def test_logits_of_rows(spark):
    rng = np.random.default_rng(5)
    members = [random_member(rng) for _ in range(2)]
    path = shared_path(spark, "network")
    network.save_network(members, path)
    rows = []
    for i in range(60):
        e = rng.normal(size=7).tolist() if i % 4 else None
        rows.append((i, *[float(v) if i % 7 or k else None for k, v in enumerate(rng.normal(size=5))], i % 4, i % 3, float(rng.normal()) if i % 5 else None, [1.0, 0.0, None][i % 9 % 3] if i % 9 < 3 else 1.0, e))
    names = ["id", *[f"t{k}" for k in range(5)], "c", "s", "llr", "av", "e"]
    df = spark.createDataFrame(rows, "id long, t0 double, t1 double, t2 double, t3 double, t4 double, c int, s int, llr double, av double, e array<double>").repartition(5)
    take = lambda **more: {r.id: r.logit for r in network.network_logits(df, path, names[1:6], "c", "s", "llr", "av", "e", **more).collect()}
    got, likely = take(), take(scale=0.7, bias=-0.1)
    for r in rows:
        there = r[10] is not None and bool(r[9])
        given = ([v or 0.0 for v in r[1:6]], r[6], r[7], (r[8] or 0.0) * there, (r[9] or 0.0) * there, r[10] if there else [0.0] * 7)
        want = sum(plain_logit(m, *given) for m in members) / 2
        assert got[r[0]] == pytest.approx(want, abs=1e-9) and likely[r[0]] == pytest.approx(1 / (1 + math.exp(-(0.7 * want - 0.1))), abs=1e-9)
    assert network.network_logits(df.limit(0), path, names[1:6], "c", "s", "llr", "av", "e").count() == 0
    with pytest.raises(Exception, match="c outside 0 to 3"):
        network.network_logits(df.withColumn("c", F.lit(4)), path, names[1:6], "c", "s", "llr", "av", "e").collect()
    with pytest.raises(Exception, match="null s"):
        network.network_logits(df.withColumn("s", F.lit(None).cast("int")), path, names[1:6], "c", "s", "llr", "av", "e").collect()
