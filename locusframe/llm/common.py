"""Helpers shared by the training-data operators: tables, the shared folder, and text splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D]. ``bytes.split()`` splits at exactly these.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, Spark's checkpoint folder if one was set; in local mode, where driver and executor are one process,
    a folder of our own. On a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="locusframe-"))
    return context.getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, or in ``folder``: its lineage is cut and losing an executor costs nothing."""
    path = f"{folder}/{label}-{uuid.uuid4().hex}" if folder else shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, folder: str) -> None:
    """Deletes ``folder``, a fresh one of ``shared_path``, when all that was read from its tables is written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows by count (use narrow rows of a written table); else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_code(text: Column) -> Column:
    """A 64-bit hash of a text (null is empty), which with the row's key tells a row from others: n^2 / 2^65 of any mix-up under one key."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, told: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` without the rows that ``told`` names, all columns kept.

    ``told`` is a written table (_lf_key, _lf_code, stays): rows with that key and ``text_code`` go, or where ``stays``
    is true all but one of them go (rows that repeat the one that stays; rare, so looked at only if there are any). The
    counted number of rows is broadcast if small, else both sides are sorted. Null keys are keys like others.
    """
    coded = docs.withColumn("_lf_own", text_code(F.col(text)))
    pairs = lambda side: coded[key].eqNullSafe(side["_lf_key"]) & (coded["_lf_own"] == side["_lf_code"])
    gone, repeated = (told.where(w).select("_lf_key", "_lf_code") for w in ("not stays", "stays"))
    if repeated.isEmpty():
        return coded.join(broadcast_if_small(gone), pairs(gone), "left_anti").select(docs.columns)
    every = told.select("_lf_key", "_lf_code")
    kept = coded.join(broadcast_if_small(every), pairs(every), "left_anti").select(docs.columns)
    once = coded.join(broadcast_if_small(repeated), pairs(repeated), "left_semi").dropDuplicates([key, "_lf_own"]).select(docs.columns)
    return kept.unionByName(once)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text at most (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for row, length in enumerate(sizes.tolist()):
            if size and size + length > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start)


def text_batches(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """``text_slices`` with their texts as ``bytes`` (null: None)."""
    for batch in text_slices(batches, column, limit):
        yield batch, batch.column(column).cast(pa.binary()).to_pylist()
