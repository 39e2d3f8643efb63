"""Exact ranking and calibration metrics as aggregates.

Scores are first summed to one row a distinct score (and group), so what is ordered afterwards doesn't grow with the rows
that share a score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.ranks import running, with_range
from locusframe.sources.shared import written


def _by_score(rows: DataFrame, score: str, label: str, by: list[str], weight: Column | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    return rows.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("q"))


def ranking(rows: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(by, positives, negatives, auc, ap): exact ROC area with half credit for ties, and step-wise average precision; null with one class only."""
    by = by or []
    sums = with_range(_by_score(rows, score, label, by, weight), F.col(score))
    up = running(sums, by, [F.col(score)], {"below": F.col("q")})
    marked = running(up, by, [F.desc(score)], {"tp": F.col("p"), "all": F.col("p") + F.col("q")}, down=True)
    tp, every = F.col("tp") + F.col("p"), F.col("all") + F.col("p") + F.col("q")
    out = marked.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum(F.when(every > 0, F.col("p") * tp / every)).alias("s"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return out.select(*by, "positives", "negatives", F.when(both, F.col("u") / (F.col("positives") * F.col("negatives"))).alias("auc"), F.when(both, F.col("s") / F.col("positives")).alias("ap"))


def calibration_error(rows: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """(ece): mean gap between score and observed rate over equal bins, the last one closed."""
    n = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    each = rows.groupBy(n.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("s"), F.avg(label).alias("l"))
    return each.agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("l"))) / F.sum("n")).alias("ece"))


def threshold_metrics(rows: DataFrame, score: str = "score", label: str = "label", at: float = 0.5) -> DataFrame:
    """Confusion counts with accuracy, precision, recall, specificity and F1 at a threshold."""
    hit, true = F.col(score) >= at, F.col(label) == 1
    c = rows.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    share = lambda a, b: F.expr(f"try_divide({a}, {b})")
    return c.select("tp", "fp", "fn", "tn", share("tp + tn", "tp + fp + fn + tn").alias("accuracy"), share("tp", "tp + fp").alias("precision"), share("tp", "tp + fn").alias("recall"), share("tn", "tn + fp").alias("specificity"), share("2 * tp", "2 * tp + fp + fn").alias("f1"))


def _poisson_steps(rate: int) -> list[float]:
    """P(X <= k) of Poisson(rate), as far as a double tells them apart."""
    steps, term, total = [], math.exp(-rate), 0.0
    for k in range(1, 1000):
        if k > rate and total + term == total:
            break
        total += term
        steps.append(total)
        term *= rate / k
    return [s for s in steps if s < 1]


#: Rows of one score and label that are drawn together in a replicate.
DRAWN = 30
#: Draws (of all replicates) that are held at once.
_HELD = 4096
#: The odd constants of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _P2
    x = (x ^ x >> np.uint64(29)) * _P3
    return x ^ x >> np.uint64(32)


def _hash_double(value: np.ndarray, seed) -> np.ndarray:
    """XXH64 of doubles as ``F.xxhash64`` has it."""
    h = seed + _P5 + np.uint64(8) ^ _turned((value + 0.0).view(np.uint64) * _P2, 31) * _P1
    return _mixed(_turned(h, 27) * _P1 + _P4)


def _hash_int(value: np.ndarray, seed) -> np.ndarray:
    h = seed + _P5 + np.uint64(4) ^ value.astype(np.uint64) * _P1
    return _mixed(_turned(h, 23) * _P2 + _P3)


def _weights(score: np.ndarray, label: int, count: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Rows x (1 + replicates): the counts themselves, then each replicate's Poisson(count) draw from a seeded hash."""
    out = np.zeros((len(score), 1 + replicates))
    out[:, 0] = count
    steps = [np.array(_poisson_steps(r)) for r in range(1, DRAWN + 1)]
    parts = -(-count // DRAWN)
    row = np.repeat(np.arange(len(score)), parts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    rate = np.minimum(DRAWN, count[row] - at * DRAWN)
    with np.errstate(over="ignore"):
        first = _hash_int(np.array([label]), _hash_double(score, np.uint64(42)))
        for i in range(0, len(row), _HELD):
            some = slice(i, i + _HELD)
            h = _hash_int(at[some], first[row[some]])[:, None]
            h = _hash_int(np.array([seed]), _hash_int(np.arange(1, replicates + 1)[None, :], h))
            u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
            for r in np.unique(rate[some]).tolist():
                hit = rate[some] == r
                own, draws = row[some][hit], np.searchsorted(steps[r - 1], u[hit], side="left")
                heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))  # a row's parts stand together
                out[own[heads], 1:] += np.add.reduceat(draws, heads, axis=0)
    return out


def bootstrap_intervals(rows: DataFrame, by: list[str], score: str = "score", label: str = "label", replicates: int = 200, seed: int = 7) -> DataFrame:
    """(by, auc, ap, auc_low, auc_high, ap_low, ap_high) of each group: estimates over all its rows, and 95 % intervals over replicates with Poisson(1) weights from a seeded hash.

    Rows are summed to scores, which are sorted in ranges of (by, score) and written once. A range draws the weights of all
    replicates of its scores as vectors: first for its sums, then again, with the sums of the ranges above and below, for the
    areas and precisions. So all groups and replicates are one plan, no row is multiplied, and a task holds one range. n
    rows of one score and label weigh Poisson(n), drawn for up to DRAWN rows at once. Replicates with one class only don't
    count. With one class in all rows of a group the area is 0.5 and the precision 0; without any replicate the bounds are
    the estimates. Null scores are left out. Without ``by`` an empty table gives one such row, with it none.
    """
    keys = [f"_g{i}" for i in range(len(by))] or ["_all"]  # without groups, one
    groups = [F.col(b) for b in by] or [F.lit(0)]
    kinds = "".join(f", {k} {rows.schema[b].dataType.simpleString()}" for k, b in zip(keys, by, strict=True)) if by else ", _all int"
    told = rows.where(F.col(score).isNotNull()).select(*[g.alias(k) for k, g in zip(keys, groups, strict=True)], F.col(score).cast("double").alias("s"), F.col(label).alias("l"))
    sums = _by_score(told, "s", "l", keys)
    ranged = written(sums.repartitionByRange(*keys, "s").withColumn("_part", F.spark_partition_id()), "scores")
    n = 1 + replicates

    def drawn(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(positive, negative) weights, from the highest score down."""
        table = table.sort_by([("s", "descending")])
        s = table.column("s").to_numpy()
        return tuple(_weights(s, l, table.column(c).to_numpy().astype(np.int64), replicates, seed) for l, c in ((1, "p"), (0, "q")))

    def row(table: pa.Table, arrays: dict[str, np.ndarray], part: bool = True) -> pa.Table:
        head = {k: table.column(k).slice(0, 1) for k in [*keys, *["_part"] * part]}
        return pa.table(head | {c: pa.array([a.tolist()], pa.list_(pa.float64())) for c, a in arrays.items()})

    def totals(table: pa.Table) -> pa.Table:
        p, q = drawn(table)
        return row(table, {"p": p.sum(axis=0), "q": q.sum(axis=0)})

    def above(table: pa.Table) -> pa.Table:
        """A group: a row a range."""
        table = table.sort_by([("_part", "descending")])
        p, q = (np.array(table.column(c).to_pylist()).reshape(-1, n) for c in "pq")
        made = {"pa": np.cumsum(p, axis=0) - p, "qa": np.cumsum(q, axis=0) - q, "pt": np.repeat(p.sum(axis=0)[None], len(p), 0), "qt": np.repeat(q.sum(axis=0)[None], len(p), 0)}
        return pa.table({k: table.column(k) for k in [*keys, "_part"]} | {c: pa.array(list(a), pa.list_(pa.float64())) for c, a in made.items()})

    def measured(scores: pa.Table, carried: pa.Table) -> pa.Table:
        p, q = drawn(scores)
        pa_, qa, qt = (np.array(carried.column(c).to_pylist()[0]) for c in ("pa", "qa", "qt"))
        tp, fp = pa_ + np.cumsum(p, axis=0), qa + np.cumsum(q, axis=0)
        every = tp + fp
        area = (p * (qt - fp + q / 2)).sum(axis=0)  # negatives below, half of the equal ones
        steps = np.divide(p * tp, every, out=np.zeros_like(p), where=every > 0).sum(axis=0)
        return row(carried, {"u": area, "s": steps, "pt": np.array(carried.column("pt").to_pylist()[0]), "qt": qt}, part=False)

    vector = lambda names: "".join(f", {c} array<double>" for c in names)
    order = (kinds + ", _part int")[2:]
    parts = ranged.groupBy(*keys, "_part").applyInArrow(totals, order + vector("pq"))
    carried = written(parts.groupBy(*keys).applyInArrow(above, order + vector(["pa", "qa", "pt", "qt"])), "above")
    both = ranged.groupBy(*keys, "_part").cogroup(carried.groupBy(*keys, "_part"))
    found = both.applyInArrow(measured, (kinds + vector(["u", "s", "pt", "qt"]))[2:])
    each = found.select(*keys, F.posexplode(F.arrays_zip("u", "s", "pt", "qt")).alias("r", "m")).groupBy(*keys, "r").agg(F.sum("m.u").alias("u"), F.sum("m.s").alias("s"), F.max("m.pt").alias("p"), F.max("m.qt").alias("q"))
    two = (F.col("p") > 0) & (F.col("q") > 0)
    judged = each.select(*keys, "r", F.when(two, F.col("u") / (F.col("p") * F.col("q"))).alias("auc"), F.when(two, F.col("s") / F.col("p")).alias("ap"))
    own = F.col("r") > 0
    stats = judged.groupBy(*keys[: len(by)]).agg(
        *[F.max(F.when(~own, F.col(m))).alias(m) for m in ("auc", "ap")],
        *[F.percentile(F.when(own, F.col(m)), F.lit(q)).alias(f"_{m}_{e}") for m in ("auc", "ap") for e, q in (("low", 0.025), ("high", 0.975))],
    )
    known = F.col("auc").isNotNull()
    bound = lambda m, e: F.when(known, F.coalesce(f"_{m}_{e}", m)).otherwise(0.5 if m == "auc" else 0.0).alias(f"{m}_{e}")
    return stats.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=False)], F.coalesce("auc", F.lit(0.5)).alias("auc"), F.coalesce("ap", F.lit(0.0)).alias("ap"), *[bound(m, e) for m in ("auc", "ap") for e in ("low", "high")])


def bootstrap_interval(rows: DataFrame, score: str = "score", label: str = "label", replicates: int = 200, seed: int = 7) -> DataFrame:
    """``bootstrap_intervals`` of all rows: one row."""
    return bootstrap_intervals(rows, [], score, label, replicates, seed)


def shuffled_labels(rows: DataFrame, key: str, label: str = "label", seed: int = 11, block_rows: int = 10_000) -> DataFrame:
    """``rows`` with labels dealt anew inside hash blocks of about ``block_rows``, by two independent orders."""
    blocks = max(1, -(-rows.count() // block_rows))
    block = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(blocks))
    a = rows.withColumns({"_b": block}).withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), key)))
    b = a.select("_b", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.col(key), F.lit(seed + 2)), key)).alias("_n"), F.col(label).alias("_l"))
    return a.join(b, ["_b", "_n"]).withColumn(label, F.col("_l")).drop("_b", "_n", "_l")


def priors(train: DataFrame, test: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """``test`` with ``prior``: the training rate of its group, else of all."""
    overall = train.agg(F.avg(label).alias("_all"))
    rates = train.groupBy(*by).agg(F.avg(label).alias("_rate"))
    return test.join(rates, by, "left").join(F.broadcast(overall)).withColumn("prior", F.coalesce("_rate", "_all")).drop("_rate", "_all")


def ensemble(members: DataFrame, key: str, logit: str = "logit") -> DataFrame:
    return members.groupBy(key).agg(F.avg(logit).alias(logit))
