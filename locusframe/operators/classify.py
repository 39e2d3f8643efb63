"""Filters, the evidence cascade and recessive resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import vcf
from locusframe.functions.features import score_tier
from locusframe.functions.hgvs import significance_tier

LOSS = ("frameshift", "splice_acceptor", "splice_donor", "splice_canonical")


def call_drop_reason(min_dp: int = 10, min_gq: int = 20, pass_only: bool = True) -> Column:
    """The first filter that a call fails, or 'kept'. A missing depth or quality fails a threshold above 0."""
    test = F.when(F.col("filter") != "PASS", "filter") if pass_only else F.when(F.lit(False), "filter")
    low = lambda c, n: ~F.coalesce(F.col(c) >= n, F.lit(n <= 0))
    return test.when(low("dp", min_dp), "depth").when(low("gq", min_gq), "quality").when(~vcf.has_alternative(F.col("gt")), "genotype").otherwise("kept")


def split_alternatives(sites: DataFrame, gt: str = "gt", alts: str = "alts") -> DataFrame:
    """One row a called alternative: alt, alt_index (0-based), n_alts and is_biallelic."""
    rows = sites.withColumn("n_alts", F.size(alts)).select("*", F.posexplode(alts).alias("alt_index", "alt"))
    rows = rows.where(F.array_contains(vcf.genotype_alleles(F.col(gt)), F.col("alt_index") + 1))
    return rows.withColumn("is_biallelic", vcf.is_biallelic(F.col(gt), F.col("alt_index") + 1))


def cascade() -> Column:
    """struct(tier, source, score, notes) of the first evidence that decides; source 'unresolved' is left for a model.

    Reads af, significance, stars, consequence, splice and ref_aa. Order: common (af > 0.01), registry with two stars or
    more, loss of function, splice score (0.5, then 0.2), splice region without a residue.
    """
    made = lambda tier, source, score, notes: F.struct(F.lit(tier).alias("tier"), F.lit(source).alias("source"), F.lit(score).alias("score"), notes.alias("notes"))
    told = significance_tier(F.col("significance"))
    low = F.lower(F.coalesce(F.col("consequence"), F.lit("")))
    splice = F.format_string("splice score %.2f", F.col("splice").cast("double"))
    return (
        F.when(F.col("af") > 0.01, made("Benign", "frequency", 0.001, F.format_string("population frequency %.4f", F.col("af").cast("double"))))
        .when((F.col("stars") >= 2) & F.col("significance").isNotNull(), F.struct(told["tier"].alias("tier"), F.lit("registry").alias("source"), told["score"].alias("score"), F.format_string("%s (%d stars)", "significance", "stars").alias("notes")))
        .when(low.rlike("|".join(LOSS)), made("Likely Pathogenic", "loss_of_function", 0.95, F.col("consequence")))
        .when(F.col("splice") >= 0.5, made("Likely Pathogenic", "splice", 0.95, splice))
        .when(F.col("splice") >= 0.2, made("VUS", "splice", 0.5, splice))
        .when(low.contains("splice_region") & F.col("ref_aa").isNull(), made("VUS", "splice_region", 0.4, F.col("consequence")))
        .otherwise(made("Unscored", "unresolved", 0.0, F.lit(None).cast("string")))
    )


def model_verdict(score: Column) -> Column:
    """struct(tier, source, score, notes) of a model's calibrated score, for rows that the cascade leaves."""
    return F.struct(score_tier(score).alias("tier"), F.lit("model").alias("source"), score.alias("score"), F.format_string("calibrated score %.4f", score).alias("notes"))


def phase_states(calls: DataFrame, order: str, by: tuple[str, ...] = ("sample_id", "gene")) -> DataFrame:
    """(by, state) of each group of heterozygous calls: single, trans, cis or unphased.

    Of repeated variants the last counts. Two calls are in trans if one phase block has them on different haplotypes, or
    if they are different alternatives of one site of which one call carries two or more. A trans pair decides, then a
    pair that can't be told, then cis. No pairs are formed: blocks and sites are counted, so a group of any size is a
    few sums.
    """
    key = ["chrom", "pos", "ref", "alt"]
    own = calls.groupBy(*by, *key).agg(F.max_by(F.struct("gt", "ps"), F.col(order)).alias("g"))
    own = own.select(*by, *key, F.col("g.ps").alias("ps"), vcf.phased_slot(F.col("g.gt")).alias("slot"), vcf.alternative_count(F.col("g.gt")).alias("n"))
    # what one site gives: calls whose slot is known by block, and whether two alternatives there exclude each other
    sites = own.groupBy(*by, "chrom", "pos").agg((F.min("alt") != F.max("alt")).alias("_several"), F.max("n").alias("_most"), F.count("*").alias("_calls"))
    # a pair at one site with other alternatives is trans if either call carries two alternatives
    marked = sites.groupBy(*by).agg(F.bool_or(F.col("_several") & (F.col("_most") >= 2)).alias("_locus"), F.sum("_calls").alias("_all"))
    blocks = own.where("slot is not null").groupBy(*by, "ps").agg(F.count("*").alias("_n"), (F.min("slot") != F.max("slot")).alias("_split"))
    held = blocks.groupBy(*by).agg(F.bool_or("_split").alias("_trans"), F.max("_n").alias("_largest"))
    found = marked.join(held, list(by), "left")
    state = (
        F.when(F.col("_all") == 1, "single").when(F.col("_locus") | F.coalesce("_trans", F.lit(False)), "trans")
        .when(F.coalesce("_largest", F.lit(0)) < F.col("_all"), "unphased").otherwise("cis")
    )
    return found.select(*by, state.alias("state"))


#: What the state of a recessive gene adds to the notes of its calls.
STATE_NOTES = {
    "trans": "two variants on different copies of a recessive gene: both copies are affected",
    "unphased": "several variants of a recessive gene whose phase is unknown: both copies can't be shown to be affected without phasing or parents",
    "cis": "several variants on one copy of a recessive gene: the other copy isn't shown to be affected",
    "single": "one variant of a recessive gene: a carrier",
}


def resolve_recessive(verdicts: DataFrame, genes: list[str], order: str) -> DataFrame:
    """Final tiers: pathogenic calls on one copy of a recessive gene are carriers unless two are in trans.

    Where ``verdicts`` has notes, the state's is added to them. ``verdicts`` is read twice: give it as a written table.
    """
    at_stake = F.col("tier").isin("Pathogenic", "Likely Pathogenic") & ~F.col("is_biallelic") & F.col("gene").isin(genes)
    states = phase_states(verdicts.where(at_stake), order)
    found = verdicts.withColumn("_at_stake", at_stake).join(states, ["sample_id", "gene"], "left")
    carrier = F.col("_at_stake") & (F.coalesce("state", F.lit("single")) != "trans")
    found = found.withColumn("state", F.when(F.col("_at_stake"), F.coalesce("state", F.lit("single"))))
    if "notes" in verdicts.columns:
        said = F.coalesce(*[F.when(F.col("state") == s, F.lit(n)) for s, n in STATE_NOTES.items()])
        found = found.withColumn("notes", F.when(said.isNull(), F.col("notes")).otherwise(F.concat_ws("; ", F.nullif("notes", F.lit("")), said)))
    return found.withColumn("tier", F.when(carrier, "Carrier (Recessive)").otherwise(F.col("tier"))).drop("_at_stake")
