"""From a registry dump to labelled variants: one drop reason a row, keep-first, and a manifest of what was counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import hgvs
from locusframe.operators import aggregates

KEY = ["chrom", "pos", "ref", "alt", "gene"]
#: The stages in the order in which they are asked; 'kept' comes last.
STAGES = ["not_in_panel", "ambiguous_gene", "assembly", "origin", "no_alleles", "same_alleles", "not_snv", "low_stars", "conflicting_indel", "foreign_gene", "kept"]


def told(rows: DataFrame, panel: list[str]) -> DataFrame:
    """``rows`` (symbols, name, significance, review, ...) with gene, label, stars and variant_class read from their texts, alleles in upper case."""
    kind = hgvs.classify_name(F.col("name"))
    return rows.withColumns({"ref": F.upper("ref"), "alt": F.upper("alt"), "gene": hgvs.single_panel_hit(F.col("symbols"), panel), "label": hgvs.significance_label(F.col("significance")), "stars": hgvs.review_stars(F.col("review")), "variant_class": kind["variant_class"]})


def drop_reason(min_stars: int = 1, indels: bool = False, longest: int = 50) -> Column:
    """The first stage that a row of ``told`` fails, or 'kept'. Stars are asked of rows labelled 0 or 1 only."""
    none = lambda c: F.coalesce(F.col(c), F.lit("")).isin("", "NA", "-", "na")
    snv = (F.length("ref") == 1) & (F.length("alt") == 1)
    fits = snv | (F.greatest(F.length("ref"), F.length("alt")) <= longest) if indels else snv
    named = hgvs.name_gene(F.col("name"))
    return (
        F.when(F.col("gene").isNull(), "not_in_panel").when(F.col("gene") == "AMBIGUOUS", "ambiguous_gene")
        .when(~F.coalesce(F.col("assembly") == "GRCh38", F.lit(False)), "assembly")
        .when(~F.coalesce(F.lower("origin").contains("germline"), F.lit(False)), "origin")
        .when(none("ref") | none("alt"), "no_alleles").when(F.col("ref") == F.col("alt"), "same_alleles").when(~fits, "not_snv")
        .when(F.col("label").isin(0, 1) & (F.col("stars") < min_stars), "low_stars").when((F.col("label") == -1) & ~snv, "conflicting_indel")
        .when(named.isNotNull() & (named != F.col("gene")), "foreign_gene").otherwise("kept")
    )


def extract(rows: DataFrame, panel: list[str], order: str, min_stars: int = 1, indels: bool = False) -> DataFrame:
    """Labelled, uncertain and conflicting variants: rows that pass every stage, the first of each (variant, gene)."""
    good = told(rows, panel).where(drop_reason(min_stars, indels) == "kept")
    return aggregates.keep_first(good, KEY, order)


def funnel(rows: DataFrame, panel: list[str], min_stars: int = 1, indels: bool = False) -> DataFrame:
    """(stage, dropped, left) of the extraction."""
    return aggregates.funnel(told(rows, panel), drop_reason(min_stars, indels), STAGES)


def gene_manifest(extracted: DataFrame, panel: DataFrame, order: str, least: int = 30) -> DataFrame:
    """One row a panel gene, those without any variant too: counts by label, sparse flag and primary transcript.

    Only single-base variants are counted. The primary transcript is that of most labelled and uncertain ones; of equals
    the one seen first, labelled variants before uncertain ones. Conflicting variants have no vote.
    """
    extracted = extracted.where((F.length("ref") == 1) & (F.length("alt") == 1))
    counts = extracted.groupBy("gene").agg(*[F.count_if(F.col("label") == v).alias(n) for n, v in (("pathogenic", 1), ("benign", 0), ("uncertain", 2), ("conflicting", -1))])
    voting = extracted.where(F.col("label").isin(0, 1, 2)).withColumns({"transcript": hgvs.name_transcript(F.col("name")), "_vote": F.struct((F.col("label") == 2).alias("later"), order)})
    primary = aggregates.mode_by(voting, "gene", "transcript", "_vote").select("gene", F.col("transcript").alias("primary_transcript"))
    full = panel.select("gene").distinct().join(counts, "gene", "left").join(primary, "gene", "left").fillna(0, ["pathogenic", "benign", "uncertain", "conflicting"])
    return full.withColumn("is_sparse", F.col("pathogenic") + F.col("benign") < least)


def manifest_json(genes: DataFrame, classes: DataFrame | None = None, parameters: dict | None = None) -> DataFrame:
    """The manifest as one JSON row: sums, genes, genes without labelled variants, sparse genes, class counts and parameters.

    It holds a row a panel gene, so it is as small as the panel. ``classes``: ``aggregates.class_counts`` of the extraction.
    """
    if classes is not None:
        genes = genes.join(classes, "gene", "left")
    sums = [F.sum(c).alias(c) for c in ("pathogenic", "benign", "uncertain", "conflicting")]
    named = lambda test: F.sort_array(F.filter(F.collect_list(F.when(test, F.col("gene"))), lambda g: g.isNotNull()))
    labelled = F.col("pathogenic") + F.col("benign")
    each = F.transform(F.sort_array(F.collect_list(F.struct(F.col("gene").alias("_g"), F.to_json(F.struct(*genes.columns)).alias("j")))), lambda x: x["j"])
    told = genes.agg(*sums, named(labelled == 0).alias("genes_without_labels"), named((labelled > 0) & F.col("is_sparse")).alias("sparse_genes"), each.alias("genes"))
    given = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in (parameters or {"stages": len(STAGES)}).items()]))
    head = F.to_json(F.struct(*[c for c in told.columns if c != "genes"]))
    # the genes are JSON already
    return told.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"genes":['), F.concat_ws(",", "genes"), F.lit('],"parameters":'), given, F.lit("}")).alias("value"))
