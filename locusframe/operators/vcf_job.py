"""From VCF files to verdicts: reader, filters, attribution, registry, cascade, recessive resolution and risks in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import vcf
from locusframe.operators import annotate, classify
from locusframe.sources import readers
from locusframe.sources.shared import written

CALL = ["sample_id", "line", "alt_index"]


@dataclass(frozen=True)
class Reference:
    """What calls are held against: registry (variant key, gene, variant_class, significance, stars, ord), intervals (gene,
    chrom, start, end), penetrance, the panel's genes and those of recessive inheritance."""

    registry: DataFrame
    intervals: DataFrame
    penetrance: DataFrame
    panel: list[str] = field(default_factory=list)
    recessive: list[str] = field(default_factory=list)


def calls_of(sites: DataFrame, min_dp: int = 10, min_gq: int = 20, pass_only: bool = True) -> DataFrame:
    """One row a called alternative of the sites that pass the filters, with gt, dp, gq, ps, af and splice."""
    text = lambda n: vcf.format_field(F.col("format"), F.col("sample"), n)
    number = lambda n: vcf.format_number(F.col("format"), F.col("sample"), n)
    rows = sites.withColumns({"gt": text("GT"), "dp": number("DP"), "gq": number("GQ"), "ps": text("PS")})
    kept = rows.where(classify.call_drop_reason(min_dp, min_gq, pass_only) == "kept")
    split = classify.split_alternatives(kept)
    info = F.col("info")
    return split.withColumns({"af": vcf.allele_frequency(info, F.col("alt_index")), "splice": F.coalesce(vcf.splice_score(info, F.col("ref"), F.col("alt"), F.col("n_alts")), F.lit(0.0))})


def interpret_calls(calls: DataFrame, held: Reference, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Verdicts of panel calls (written on the way): gene and annotation, registry's word, tier, source, model_score, notes, state and risks.

    ``score`` gives the calls that no evidence decides a calibrated ``model_score``; without it they stay unscored.
    """
    named = annotate.attribute_genes(calls, held.registry, held.intervals, held.panel, CALL, "ord", ["significance", "stars"])
    found = annotate.in_panel(named, held.panel).withColumn("_v", classify.cascade())
    if score is not None:
        found = written(found, "judged")  # read by the model's part and the rest
        open_ = score(found.where("_v.source = 'unresolved'").drop("_v")).withColumn("_v", classify.model_verdict(F.col("model_score"))).drop("model_score")
        found = found.where("_v.source <> 'unresolved'").unionByName(open_)
    rows = found.select("*", F.col("_v.tier").alias("tier"), F.col("_v.source").alias("source"), F.col("_v.score").alias("model_score"), F.col("_v.notes").alias("notes")).drop("_v")
    rows = written(rows, "verdicts")  # read for the states, then for the result
    return annotate.attach_risks(classify.resolve_recessive(rows, held.recessive, "line"), held.penetrance)


def interpret(spark: SparkSession, paths, held: Reference, score: Callable[[DataFrame], DataFrame] | None = None, **filters) -> DataFrame:
    """Verdicts of VCF files on GRCh38; raises for a file on another assembly."""
    readers.require_assembly(spark, paths)
    return interpret_calls(calls_of(readers.read_vcf(spark, paths), **filters), held, score)
