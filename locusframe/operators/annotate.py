"""Joins of calls with registries, intervals and risk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions import vcf
from locusframe.operators.intervals import interval_matches
from locusframe.sources.shared import shared_path, written

KEY = ["chrom", "pos", "ref", "alt"]


def last_wins(registry: DataFrame, order: str, key: list[str] = KEY) -> DataFrame:
    """One row a key, that with the greatest ``order``; summed before the shuffle, no window."""
    rest = [c for c in registry.columns if c not in key]
    best = registry.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*key, "_r.*")


def lay_out_registry(registry: DataFrame, table: str, order: str, buckets: int = 64) -> DataFrame:
    """The registry as a bucketed table ``table``, one row a variant (that with the greatest ``order``), sorted by its key.

    Written once, it is joined by every later job without an exchange or a sort of its side: calls are dealt into its
    ``buckets``. Take as many that a bucket's rows fit a task (a registry of 1e9 rows: some thousands).
    """
    path = shared_path(registry.sparkSession, "registry")
    last_wins(registry, order).write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(table)
    return registry.sparkSession.table(table)


def registry_lookup(calls: DataFrame, registry: DataFrame, order: str) -> DataFrame:
    """Exact lookup; Spark chooses between broadcast and sort-merge by size."""
    return calls.join(last_wins(registry, order), KEY, "left")


NON_CANCER = "pneumothorax|leiomyomatosis|thrombocytopenia|aplastic anemia|bone marrow"


def risk_arrays(penetrance: DataFrame) -> DataFrame:
    """One row a gene with its cancer and other risks as arrays: joined 1:1, calls don't multiply."""
    risk = F.struct("outcome", "risk_low_pct", "risk_high_pct", "up_to_age", "source", "evidence_level")
    other = F.lower("outcome").rlike(NON_CANCER)
    pick = lambda test: F.sort_array(F.filter(F.collect_list(F.when(test, risk)), lambda r: r.isNotNull()))
    return penetrance.groupBy("gene").agg(pick(~other).alias("cancer_risks"), pick(other).alias("other_risks"))


def attach_risks(verdicts: DataFrame, penetrance: DataFrame) -> DataFrame:
    """Risks for pathogenic and likely pathogenic rows only."""
    found = verdicts.join(risk_arrays(penetrance), "gene", "left")
    hit = F.col("tier").isin("Pathogenic", "Likely Pathogenic")
    return found.withColumns({c: F.when(hit, F.col(c)) for c in ("cancer_risks", "other_risks")})


def best_ranges(risks: DataFrame, by: list[str], order: str | None = None, told: list[str] = ("up_to_age",)) -> DataFrame:
    """The greatest (high, low) range of each group with the ``told`` columns of its row, the first by ``order`` of equals."""
    first = [] if order is None else [-F.col(order)]
    best = F.max_by(F.struct("risk_high_pct", "risk_low_pct", *told), F.struct("risk_high_pct", "risk_low_pct", *(first or told)))
    return risks.groupBy(*by).agg(best.alias("_m")).select(*by, "_m.*")


def lookup(rows: DataFrame, dimension: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """Left join with defaults for what is missing."""
    found = rows.join(dimension, on, "left")
    return found.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def require_known(rows: DataFrame, dimension: DataFrame, key: str) -> None:
    """Raises, naming up to ten keys that the dimension lacks."""
    if unknown := rows.select(key).distinct().join(dimension, key, "left_anti").limit(10).collect():
        raise ValueError(f"unknown {key}: " + ", ".join(sorted(str(r[0]) for r in unknown)))


def best_candidate(candidates: DataFrame, group: str, good: Column, order: str) -> DataFrame:
    """The first good candidate of each group, else the first."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(good.desc(), order))).where("_n = 1").drop("_n")


#: What is read off a call's texts; they aren't carried on.
PARSED = ("info", "format", "sample", "alts")


def attribute_genes(calls: DataFrame, registry: DataFrame, intervals: DataFrame, panel: list[str], key: list[str], order: str, told: list[str] = ()) -> DataFrame:
    """``calls`` with gene, gene_source and what comes with it: consequence, transcript, hgvs_c, hgvs_p, ref_aa, alt_aa, aa_pos.

    The first of these that names a gene decides, and all other fields follow it: a CSQ entry of this allele with a
    panel symbol, such an ANN entry, the registry's row of this variant (its gene need not be in the panel), the only
    interval that holds the position (intronic). ``calls`` has info, n_alts and the unique ``key``; ``registry`` has the
    variant key, gene, variant_class and ``order`` (the last row of a variant counts), and the ``told`` columns, which come
    along. The registry is joined once and INFO is parsed once: rows with what was read (without the PARSED texts) are
    written, then those without a gene are held against the intervals. Rows with one are neither sorted nor shuffled again.
    """
    read = lambda tag, fields: vcf.first_annotation(F.col("info"), tag, fields, F.col("ref"), F.col("alt"), F.col("n_alts"), panel)
    rows = calls.withColumn("_csq", read("CSQ", vcf.CSQ_FIELDS)).withColumn("_ann", read("ANN", vcf.ANN_FIELDS))
    known = last_wins(registry.select(*KEY, F.col("gene").alias("_g"), F.col("variant_class").alias("_class"), *told, order), order).drop(order)
    rows = written(rows.join(known, KEY, "left").drop(*PARSED), "named")
    named = F.coalesce(F.col("_csq.symbol"), F.col("_ann.symbol"), F.col("_g"))
    # rows without a gene go through the sweep whole, so no join brings its result back to them
    open_ = rows.where(named.isNull()).select(F.col("chrom"), F.col("pos"), F.struct(*rows.columns).alias("_row"))
    placed = interval_matches(open_, intervals, ["_row"]).select("_row.*", F.col("gene").alias("_place"))
    rows = rows.where(named.isNotNull()).withColumn("_place", F.lit(None).cast("string")).unionByName(placed)
    source = F.when(F.col("_csq").isNotNull(), "csq").when(F.col("_ann").isNotNull(), "ann").when(F.col("_g").isNotNull(), "registry").when(F.col("_place").isNotNull(), "interval")
    both = lambda n: F.when(F.col("_csq").isNotNull(), F.col(f"_csq.{n}")).otherwise(F.col(f"_ann.{n}"))
    residues = F.split("_csq.residues", "/")
    pair = lambda i: F.when(F.size(residues) >= 2, F.get(residues, F.lit(i)))
    consequence = F.when(source.isin("csq", "ann"), both("consequence")).when(source == "registry", F.col("_class")).when(source == "interval", "intronic")
    made = {
        "gene": F.coalesce(named, "_place"), "gene_source": source, "consequence": consequence, "transcript": both("transcript"), "hgvs_c": both("hgvs_c"), "hgvs_p": both("hgvs_p"),
        "ref_aa": pair(0), "alt_aa": pair(1), "aa_pos": F.when(F.col("_csq.position").rlike(r"^\d+$"), F.col("_csq.position").try_cast("int")),
    }
    return rows.withColumns(made).drop("_csq", "_ann", "_g", "_class", "_place")


def in_panel(calls: DataFrame, panel: list[str]) -> DataFrame:
    """Calls whose gene is in the panel."""
    return calls.where(F.col("gene").isin(panel))


def score_lookup(rows: DataFrame, cache: DataFrame, width: int) -> DataFrame:
    """``rows`` with scores and embedding of their (gene, aa_pos); without an entry scores are null, the embedding is zeros and ``has_scores`` 0."""
    found = rows.join(cache.withColumn("_hit", F.lit(1)), ["gene", "aa_pos"], "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    return found.withColumns({"has_scores": F.coalesce("_hit", F.lit(0)), "embedding": F.coalesce(F.col("embedding").cast("array<float>"), zeros)}).drop("_hit")


def sequence_lookup(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """``rows`` with ``residue_status``: whether the gene's sequence has the reference residue at its place."""
    from locusframe.functions.features import residue_status

    found = rows.join(sequences.select("gene", F.col("seq").alias("_seq")), "gene", "left")
    return found.withColumn("residue_status", residue_status(F.col("_seq"), F.col("aa_pos"), F.col("ref_aa"))).drop("_seq")


def baseline_lookup(risks: DataFrame, baselines: DataFrame) -> DataFrame:
    """``risks`` with the population's rate of their outcome; an unknown one stays null and is told as unavailable."""
    found = risks.join(baselines.select("outcome", F.col("rate").alias("baseline")), "outcome", "left")
    return found.withColumn("baseline_text", F.when(F.col("baseline").isNull(), "Baseline unavailable").otherwise(F.format_string("~%.1f%% general pop.", F.col("baseline").cast("double"))))


def risk_fan_out(calls: DataFrame, risks: DataFrame, probability: str, key: list[str], default: str = "GEN_DEFAULT") -> DataFrame:
    """A row a call and outcome with ``expected`` = probability x rate and ``place`` by it in the call, largest first.

    ``key`` tells one call from another, so calls that are equal in all else have places of their own. Genes without a row in ``risks`` (gene, outcome, rate) take those of ``default``.
    """
    known = risks.select(F.col("gene").alias("_known")).distinct()
    at = calls.join(known, calls["gene"] == known["_known"], "left").withColumn("_gene", F.coalesce("_known", F.lit(default))).drop("_known")
    rows = at.join(risks.select(F.col("gene").alias("_gene"), "outcome", "rate"), "_gene").withColumn("expected", F.col(probability) * F.col("rate")).drop("_gene")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("expected"), "outcome")))
