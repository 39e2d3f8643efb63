"""Exact global ranks without one task for all rows.

Rows are cut into ranges by approximate quantiles, ranges are counted, and rows are ordered inside their range only. The
quantiles decide how even the ranges are, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.sources.shared import written

#: Rows of one range, roughly.
RANGE_ROWS = 500_000
_MOST_RANGES = 10_000


def with_range(rows: DataFrame, order: Column, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``_range``, an int that grows with the numeric ``order``; equal values share a range, nulls are in range 0."""
    ranges = min(_MOST_RANGES, -(-rows.count() // range_rows))
    if ranges < 2:
        return rows.withColumn("_range", F.lit(0))
    cuts = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts"))  # one row
    return rows.join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < order))).drop("_cuts")


def running(ranged: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], down: bool = False) -> DataFrame:
    """``ranged`` with the sums of all rows before each in its group (``down``: from the top), the row itself left out.

    Ranges' sums are a row a group and range; the running sums inside a range are added to those of the ranges before.
    """
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    across = Window.partitionBy(*by).orderBy(F.desc("_range") if down else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_f_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({f"_i_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    joined = own.join(first, [*by, "_range"])
    return joined.withColumns({n: F.col(f"_f_{n}") + F.col(f"_i_{n}") for n in sums}).drop(*[f"_{k}_{n}" for k in "fi" for n in sums])


def positions(rows: DataFrame, by: list[str], order: list[Column], name: str = "_n") -> DataFrame:
    """``rows`` with their number from 1 in each group by ``order``, of any types; no task holds a group, however equal its rows.

    Rows are sorted in ranges of (by, order) and the sorted table is written, which fixes the ranges; a range's rows are
    numbered by their place in it, and a group's ranges are counted (a row a group and range). Rows equal in ``order`` are
    numbered in an unspecified order. Nulls come first (last where the order descends).
    """
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    # the lower 33 bits of the id number the rows of a partition, in their order
    placed = ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = written(placed, "sorted")
    parts = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col("_part").alias("_p"), (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    if not by:
        starts = F.broadcast(starts)  # a row a partition
    same = placed["_part"] == starts["_p"]
    for i, b in enumerate(by):
        same &= placed[b].eqNullSafe(starts[f"_b{i}"])
    return placed.join(starts, same).withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_p", "_start", *[f"_b{i}" for i in range(len(by))])


def dictionary(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the distinct values of a column, null left out, with their 0-based rank by value."""
    values = rows.where(F.col(column).isNotNull()).select(column).distinct()
    return positions(values, [], [F.col(column)], name).withColumn(name, F.col(name) - 1)


def numbered(rows: DataFrame, by: list[str], order: Column, ties: list[str], name: str = "_n") -> DataFrame:
    """``rows`` with their exact number from 1 in each group by ``order``, then by ``ties``."""
    ranged = with_range(rows.withColumn("_order", order), F.col("_order"))
    out = running(ranged, by, [F.col("_order"), *[F.col(t) for t in ties]], {name: F.lit(1)})
    return out.withColumn(name, F.col(name) + 1).drop("_range", "_order")
