"""The evaluation job: out-of-fold scores, splits by models, and intervals compared."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators import aggregates, metrics, splits
from locusframe.sources.shared import written

Learner = Callable[[DataFrame, DataFrame], DataFrame]


def out_of_fold(rows: DataFrame, learn: Learner, fold: str = "fold", folds: int = 5) -> DataFrame:
    """Every row scored once, by a model of the other folds; ``learn(train, test)`` returns ``test`` with a score."""
    return reduce(DataFrame.unionByName, [learn(rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)) for k in range(folds)])


NestedLearner = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def nested_out_of_fold(rows: DataFrame, learners: dict[str, NestedLearner], group: str, scaled: list[str] = (), folds: int = 5, inner: int = 6) -> DataFrame:
    """``rows`` once a model, with model, round and score: each scored in the round that tests its group.

    ``learn(train, validation, test)`` returns ``test`` with a score. Rows are tagged once (``splits.nested_folds``) and
    stored; in each round the ``scaled`` columns are standardised by its training rows only.
    """
    tagged = written(splits.nested_folds(rows, group, folds, inner), "folds")
    parts = []
    for k in range(folds):
        sides = [tagged.where(F.get("roles", F.lit(k)) == side).drop("roles") for side in ("train", "validation", "test")]
        if scaled:
            sides = [aggregates.standardised(side, list(scaled), sides[0]) for side in sides]
        for name, learn in learners.items():
            parts.append(learn(*sides).select(*rows.columns, F.col("score").cast("double").alias("score"), F.lit(name).alias("model"), F.lit(k).alias("round")))
    return reduce(DataFrame.unionByName, parts)


def ablation(splits: dict[str, tuple[DataFrame, DataFrame]], learners: dict[str, Learner], label: str = "label", replicates: int = 200) -> DataFrame:
    """(split, model, auc, ap, auc_low, auc_high, ap_low, ap_high), a row a split and model with any scored row.

    All are scored in one union and measured in one plan; the table, a few rows, is written, so what compares it with
    itself doesn't measure again.
    """
    scored = [learn(train, test).select(F.col("score").cast("double").alias("score"), label, F.lit(name).alias("split"), F.lit(model).alias("model")) for name, (train, test) in splits.items() for model, learn in learners.items()]
    return written(metrics.bootstrap_intervals(reduce(DataFrame.unionByName, scored), ["split", "model"], label=label, replicates=replicates), "ablation")


def overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Whether two closed intervals meet."""
    return F.greatest(low_a, low_b) <= F.least(high_a, high_b)


def overlapping(table: DataFrame, by: str = "split", model: str = "model", metric: str = "auc") -> DataFrame:
    """(by, a, b, overlap) of each pair of models of one split; the table has a row a model, so pairs are few."""
    side = lambda n: table.select(by, F.col(model).alias(n), F.col(f"{metric}_low").alias(f"_l{n}"), F.col(f"{metric}_high").alias(f"_h{n}"))
    pairs = side("a").join(side("b"), by).where("a < b")
    return pairs.select(by, "a", "b", overlap(F.col("_la"), F.col("_ha"), F.col("_lb"), F.col("_hb")).alias("overlap"))
