"""Calls as a stream: what is stateless runs unchanged on a streaming DataFrame, against a static registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import annotate, classify


def classified_stream(calls: DataFrame, registry: DataFrame, order: str) -> DataFrame:
    """Filters, registry lookup (stream-static join) and cascade; recessive resolution needs a whole sample and is left to batches.

    ``calls`` has filter, dp, gq, gt, af, consequence, splice and ref_aa besides the key.
    """
    kept = calls.where(classify.call_drop_reason() == "kept")
    found = annotate.registry_lookup(kept, registry, order)
    return found.withColumn("v", classify.cascade()).withColumns({"tier": F.col("v.tier"), "source": F.col("v.source")}).drop("v")
