"""The feature table of labelled variants: joins to supplied dimensions, then Column expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions import features, hgvs
from locusframe.operators import aggregates, annotate

PROPERTIES = ("mw", "charge", "logp", "tpsa")
#: Columns that get the number of their value, and its name.
IDS = {"gene": "gene_id", "syndrome_group": "syndrome_id"}


def with_ids(rows: DataFrame, fitted: dict[str, DataFrame] | None = None, unknown: str = "error") -> DataFrame:
    """``rows`` with gene_id and, where they have a syndrome_group, syndrome_id: ranks among the sorted distinct values.

    ``fitted`` has the dictionaries of a training table by column (``ranks.dictionary``), for serving; ``unknown`` says what
    becomes of values that they lack (``aggregates.ordinal``).
    """
    for column, name in IDS.items():
        if column in rows.columns:
            rows = aggregates.ordinal(rows, column, name, (fitted or {}).get(column), unknown)
    return rows


def featurise(variants: DataFrame, genes: DataFrame, residues: DataFrame, pairs: DataFrame, unknown_genes: str = "error") -> DataFrame:
    """``variants`` with their features; all rows and columns kept.

    ``genes``: gene, strand, length. A gene without a row stops the job before it starts, naming up to ten such genes; with
    ``unknown_genes`` 'default' it counts as '+' and 1000 long. ``residues``: aa and the PROPERTIES of the
    standard ones. ``pairs``: ref_aa, alt_aa, distance, dissimilarity. Residues and pairs are tables of 20 and 400 rows by
    their nature. Variants have ref, alt, variant_class, ref_aa, alt_aa and aa_pos. Dissimilarity is 1 for starts and
    stops, 0 for equal residues.
    """
    if unknown_genes not in ("error", "default"):
        raise ValueError(f"unknown_genes={unknown_genes!r}: error or default")
    if unknown_genes == "error":
        annotate.require_known(variants, genes, "gene")
    kind = F.col("variant_class")
    side = lambda which: residues.select(F.col("aa").alias(f"{which}_aa"), *[F.col(p).alias(f"_{which}_{p}") for p in PROPERTIES])
    rows = variants.join(genes.select("gene", F.col("strand").alias("_strand"), F.col("length").alias("_length")), "gene", "left")
    rows = rows.join(F.broadcast(side("ref")), "ref_aa", "left").join(F.broadcast(side("alt")), "alt_aa", "left")
    rows = rows.join(F.broadcast(pairs.select("ref_aa", "alt_aa", F.col("distance").alias("_distance"), F.col("dissimilarity").alias("_unlike"))), ["ref_aa", "alt_aa"], "left")
    met = residues.where("aa = 'M'").select(*[F.col(p).alias(f"_met_{p}") for p in PROPERTIES])  # one row
    rows = rows.join(F.broadcast(met), how="left").withColumn("_change", features.change_kind(kind, F.col("ref_aa"), F.col("alt_aa")))
    change = F.col("_change")
    strand = F.coalesce("_strand", F.lit("+"))
    made = {
        "has_protein_change": change.isNotNull().cast("int"),
        "rel_protein_pos": F.when(change.isNull() | (change == "start_lost"), 0.0).otherwise(features.relative_position(F.col("aa_pos"), F.coalesce("_length", F.lit(1000)), kind)),
        "severity": features.severity(kind, F.col("_distance"), F.col("ref_aa"), F.col("alt_aa")),
        "dissimilarity": F.when(change.isin("start_lost", "stop_lost", "stop"), 1.0).when((change == "exchange") & (F.col("ref_aa") != F.col("alt_aa")), F.round("_unlike", 4)).otherwise(0.0),
        "is_transition": features.is_transition(F.upper("ref"), F.upper("alt")),
        "variant_class_id": hgvs.class_id(kind),
    }
    for p in PROPERTIES:
        # a lost start loses methionine's mass; its other properties count as unchanged
        made[f"delta_{p}"] = features.property_delta(change, F.col(f"_ref_{p}"), F.col(f"_alt_{p}"), F.col("_met_mw") if p == "mw" else 0.0)
    made |= features.one_hots(F.col("ref"), F.col("alt")) | features.one_hots(F.upper("ref"), F.upper("alt"), strand)
    gone = [c for c in rows.columns if c.startswith(("_ref_", "_alt_", "_met_"))] + ["_strand", "_length", "_distance", "_unlike", "_change"]
    return rows.withColumns(made).drop(*gone).select(*variants.columns, *made)


def filled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and not-a-numbers of feature columns as 0."""
    return rows.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})
