"""Points held against intervals by a sweep over sorted ranges.

Starts, points and ends are one list of events by (chromosome, place), sorted in ranges with borders from samples. A sweep
over a range keeps two sums over the intervals that are open: their number, and the sum of their numbers. Where one is open
the second sum names it. What a range leaves open is added to the ranges after it, so an interval is two events however
long it is, and points and intervals are never multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.ranks import positions
from locusframe.sources.shared import written

_START, _POINT, _END = 0, 1, 2


def _events(points: DataFrame, spans: DataFrame, key: list[str], chrom: str, pos: str) -> DataFrame:
    """(chrom, at, kind, step, span, key): what the sweep reads, in no order yet."""
    own = points.select(F.col(chrom).cast("string").alias("_chrom"), F.col(pos).cast("bigint").alias("_at"), F.lit(_POINT).alias("_kind"), F.lit(0).cast("bigint").alias("_step"), F.lit(0).cast("bigint").alias("_span"), *key)
    sides = [spans.select("_chrom", F.col(c).alias("_at"), F.lit(kind).alias("_kind"), F.lit(sign).cast("bigint").alias("_step"), (sign * F.col("_span")).alias("_span")) for c, kind, sign in (("_from", _START, 1), ("_to", _END, -1))]
    return own.unionByName(sides[0], allowMissingColumns=True).unionByName(sides[1], allowMissingColumns=True)


def _swept(events: DataFrame, key: list[str]) -> DataFrame:
    """(part, chrom, is_point, open, span, key) of each point with the sums inside its range, and of each range and chromosome with what it leaves open."""
    order = ["_chrom", "_at", "_kind"]
    kept = [f for f in events.schema if f.name in key]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, np.zeros(2, np.int64)

        def made(chrom, is_point: bool, sums, keys: list) -> pa.RecordBatch:
            n = len(sums[0])
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), chrom, pa.array([is_point] * n, pa.bool_()), *[pa.array(s, pa.int64()) for s in sums], *keys], ["_part", "_chrom", "_is_point", "_open", "_span", *[f.name for f in kept]])

        for batch in batches:
            if not batch.num_rows:
                continue
            chrom = batch.column("_chrom")
            starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(chrom[1:], chrom[:-1]).to_numpy(zero_copy_only=False)]))
            fresh = chrom[0].as_py() != last  # else the batch goes on with the last one's chromosome
            sums, left = [], []
            for i, name in enumerate(("_step", "_span")):
                step = batch.column(name).to_numpy(zero_copy_only=False)
                total = np.cumsum(step)
                base = (total - step)[starts]
                base[0] = 0 if fresh else -carry[i]
                run = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(step)))
                own = total - base[run]
                sums.append(own)
                ends = np.append(starts[1:], len(step)) - 1
                left.append(([carry[i]] if fresh and last is not None else []) + own[ends[:-1]].tolist())
                carry[i] = own[-1]
            done = ([last] if fresh and last is not None else []) + chrom.take(pa.array(np.append(starts[1:], len(chrom))[:-1] - 1)).to_pylist()
            if done:
                yield made(pa.array(done, pa.string()), False, left, [pa.nulls(len(done), batch.column(f.name).type) for f in kept])
            last = chrom[-1].as_py()
            points = pc.equal(batch.column("_kind"), _POINT)
            mask = points.to_numpy(zero_copy_only=False)
            if mask.any():
                yield made(chrom.filter(points), True, [s[mask] for s in sums], [batch.column(f.name).filter(points) for f in kept])
            kinds = [batch.column(f.name).type for f in kept]
        if last is not None:
            yield made(pa.array([last], pa.string()), False, [[c] for c in carry], [pa.nulls(1, k) for k in kinds])

    keys = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    ranged = events.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(sweep, f"_part bigint, _chrom string, _is_point boolean, _open bigint, _span bigint{keys}")


def interval_matches(points: DataFrame, intervals: DataFrame, key: list[str], chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """(key, n, gene) of each point: how many intervals hold it, and the gene if exactly one does.

    ``intervals``: gene, chrom, start, end, both ends inside; those without a gene, a chromosome or an end, and those that
    end before they start, hold nothing. Points without a place are held by none. Points and intervals of any number and
    length are sorted once; ranges' sums are a row a range and chromosome.
    """
    told = intervals.select("gene", F.col("chrom").cast("string").alias("_chrom"), F.col("start").cast("bigint").alias("_from"), F.col("end").cast("bigint").alias("_to")).where("gene is not null and _chrom is not null and _from <= _to")
    spans = positions(told, [], [F.col(c) for c in ("_chrom", "_from", "_to", "gene")], "_span")
    placed = F.col(chrom).isNotNull() & F.col(pos).isNotNull()
    swept = written(_swept(_events(points.where(placed), spans, key, chrom, pos), key), "swept")
    left = swept.where("not _is_point").groupBy("_chrom", "_part").agg(F.sum("_open").alias("_o"), F.sum("_span").alias("_s"))
    before = Window.partitionBy("_chrom").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("_chrom", "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_o", "_s")])
    open_ = swept.where("_is_point").join(carried, ["_chrom", "_part"])
    found = open_.select(*key, (F.col("_open") + F.col("_o_before")).alias("n"), (F.col("_span") + F.col("_s_before")).alias("_id"))
    one = found.withColumn("_id", F.when(F.col("n") == 1, F.col("_id")))
    named = one.join(spans.select(F.col("_span").alias("_id"), "gene"), "_id", "left").select(*key, "n", "gene")
    return named.unionByName(points.where(~placed).select(*key, F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("gene")))
