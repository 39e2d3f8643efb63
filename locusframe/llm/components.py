"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Expects u > v, which ``_large_star`` gives."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str, rounds: int = 50, folder: str | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` that has a link to another; component is the least node reached.

    Works on any orderable column type. Each round is two joins and a written table, so hot nodes are summed before
    the shuffle, an adaptive join splits them, and nothing but one (count, checksum) row reaches the driver. Self-links,
    repeated and null links are ignored. ``rounds`` is a guard only: passing it raises, it never returns a partial
    result (the number needed grows as the logarithm of the longest path). The tables are written to ``folder``, if given.
    """
    edges = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", folder)
    before = None
    for _ in range(rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if state == before or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        edges = written(_small_star(_large_star(edges)), "edges", folder)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
