"""Baseline models, by Spark's own learners."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from locusframe.sources.shared import written


def _vectors(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="keep").transform(rows)


def balanced_weight(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``_weight``: both classes weigh the same."""
    n = rows.agg(F.count("*").alias("_n"), F.sum(label).alias("_p"))
    return rows.join(F.broadcast(n)).withColumn("_weight", F.when(F.col(label) == 1, F.col("_n") / (2 * F.col("_p"))).otherwise(F.col("_n") / (2 * (F.col("_n") - F.col("_p"))))).drop("_n", "_p")


def logistic_scores(train: DataFrame, test: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    model = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", maxIter=50).fit(_vectors(balanced_weight(train, label), columns))
    return _scored(model, test, columns)


def boosted_scores(train: DataFrame, test: DataFrame, columns: list[str], label: str = "label", rounds: int = 100, validation: DataFrame | None = None) -> DataFrame:
    """With ``validation``, rounds end when its error no longer falls."""
    trees = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, stepSize=0.1, maxDepth=5, seed=1)
    if validation is not None:
        train = train.withColumn("_held", F.lit(False)).unionByName(validation.withColumn("_held", F.lit(True)))
        trees = trees.setValidationIndicatorCol("_held")
    return _scored(trees.fit(_vectors(train, columns)), test, columns)


def boosted_with_components(train: DataFrame, test: DataFrame, columns: list[str], embedding: str, label: str = "label", k: int = 16, rounds: int = 100, validation: DataFrame | None = None) -> DataFrame:
    """Boosted trees over ``columns`` and the ``k`` leading components of an embedding, fitted on training rows only."""
    _, vectors = svd_components(train, embedding, k)
    names = [f"_svd_{i}" for i in range(len(vectors))]
    made = [None if rows is None else projected(rows, embedding, vectors, "_svd").fillna(0.0, names) for rows in (train, test, validation)]
    return boosted_scores(made[0], made[1], [*columns, *names], label, rounds, made[2]).drop(*names)


def network_scores(train: DataFrame, test: DataFrame, columns: list[str], label: str = "label", hidden: tuple[int, ...] = (16,)) -> DataFrame:
    """A perceptron; it takes no weights, so rows of the rarer class are repeated."""
    n = train.agg(F.count("*").alias("n"), F.sum(label).alias("p")).first()
    rare, times = (1, round((n["n"] - n["p"]) / max(n["p"], 1))) if 2 * n["p"] < n["n"] else (0, round(n["p"] / max(n["n"] - n["p"], 1)))
    repeated = train.withColumn("_r", F.explode(F.sequence(F.lit(1), F.when(F.col(label) == rare, F.lit(max(1, times))).otherwise(1))))
    model = MultilayerPerceptronClassifier(featuresCol="_features", labelCol=label, layers=[len(columns), *hidden, 2], seed=1, maxIter=60).fit(_vectors(repeated, columns))
    return _scored(model, test, columns)


def _scored(model, test: DataFrame, columns: list[str]) -> DataFrame:
    out = model.transform(_vectors(test, columns))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def platt(validation: DataFrame, logit: str, label: str = "label") -> DataFrame:
    """(scale, bias) of the logistic curve fitted to one logit column."""
    model = LogisticRegression(featuresCol="_features", labelCol=label, regParam=0.0, maxIter=100).fit(_vectors(validation, [logit]))
    return validation.sparkSession.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "scale double, bias double")


def _arrays(batch: pa.RecordBatch, column: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows with an array as a matrix, which rows those are)."""
    told = batch.column(column)
    there = np.flatnonzero(told.is_valid().to_numpy(zero_copy_only=False))
    flat = told.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(there), -1 if len(there) else (width or 0)), there


def right_factor(rows: DataFrame, column: str, fan: int = 16) -> np.ndarray:
    """The triangular factor of all arrays of a column, one under the other (a QR without Q): at most width x width.

    A task folds its batches into one factor; factors are folded ``fan`` at a time until one is left, so neither a task
    nor the driver holds more than ``fan`` of them. Rows without an array don't count; arrays of two widths raise.
    """
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = None
        for batch in batches:
            x, _ = _arrays(batch, batch.schema.get_field_index("x"))
            if len(x):
                factor = np.linalg.qr(x if factor is None else np.vstack([factor, x]), mode="r")
        if factor is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(factor), pa.list_(pa.float64())), pa.array(np.full(len(factor), TaskContext.get().partitionId()))], ["x", "part"])

    one = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("x"))
    factors = written(one.mapInArrow(folded, "x array<double>, part bigint"), "factors")
    while (parts := factors.select("part").distinct().count()) > 1:
        dealt = factors.repartition(max(1, -(-parts // fan)), F.floor(F.col("part") / fan))
        factors = written(dealt.select("x").mapInArrow(folded, "x array<double>, part bigint"), "factors")
    return np.array([r["x"] for r in factors.collect()])  # width rows at most


def svd_components(rows: DataFrame, column: str, k: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as rows) of an array column, not centred; the first ``k``.

    Signs are fixed: each vector's entry of greatest size is positive. An empty table has none.
    """
    factor = right_factor(rows, column)
    if not factor.size:
        return np.zeros(0), np.zeros((0, 0))
    _, values, vectors = np.linalg.svd(factor, full_matrices=False)
    values, vectors = values[:k], vectors[:k]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return values, vectors * np.where(signs == 0, 1, signs)[:, None]


def projected(rows: DataFrame, column: str, vectors: np.ndarray, output: str = "component") -> DataFrame:
    """``rows`` with ``output``_0, ``output``_1, ...: the arrays' products with the right vectors, a batch at once; null without an array."""
    names = [f"{output}_{i}" for i in range(len(vectors))]
    schema = rows.schema
    for n in names:
        schema = StructType([*schema.fields, StructField(n, DoubleType())])
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, there = _arrays(batch, at, vectors.shape[1])
            made = np.full((batch.num_rows, len(vectors)), np.nan)
            made[there] = x @ vectors.T
            held = np.zeros(batch.num_rows, bool)
            held[there] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.float64(), mask=~held) for c in made.T]], [*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


def truncated_svd(rows: DataFrame, column: str, k: int = 16) -> DataFrame:
    """(component, value): the leading singular values of an array column, not centred; rows without an array don't count."""
    values, _ = svd_components(rows, column, k)
    return rows.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(values)], "component int, value double")


def score_batches(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], output: str = "logit") -> DataFrame:
    """Applies a trained scorer to Arrow batches of the feature table."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame[output] = scorer(frame).astype(float)
            yield frame

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{output}` double")
