"""Report tables of verdicts: risk table, display rows, text lines and JSON, a sample at a time by grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.annotate import best_ranges
from locusframe.sources.shared import written

ACTIONABLE = ("Pathogenic", "Likely Pathogenic")
BENIGN = ("Benign", "Likely Benign")
DISCLAIMER = "Research output of a variant table. Not a diagnosis; findings have to be confirmed by a qualified laboratory and clinician."


def actionable(tier: Column) -> Column:
    return tier.isin(*ACTIONABLE)


def display_annotation(hgvs_p: Column, hgvs_c: Column, consequence: Column) -> Column:
    """The first of protein name, coding name and consequence that says something; else a dash."""
    told = [F.nullif(F.nullif(c, F.lit("")), F.lit(".")) for c in (hgvs_p, hgvs_c, consequence)]
    return F.coalesce(*told, F.lit("—"))


def risk_range(low: Column, high: Column) -> Column:
    """Two percentages as text, rounded half to even."""
    whole = lambda c: F.bround(c, 0).cast("bigint").cast("string")
    return F.concat(whole(low), F.lit("% - "), whole(high), F.lit("%"))


def parse_range(text: Column) -> Column:
    """struct(low, high) of such a text."""
    part = lambda i: F.regexp_extract(text, r"^\s*([0-9.]+)%\s*-\s*([0-9.]+)%\s*$", i).try_cast("double")
    return F.struct(part(1).alias("low"), part(2).alias("high"))


def risk_table(verdicts: DataFrame, order: str, sample: str = "sample_id") -> DataFrame:
    """(sample, place, outcome, gene, low, high, range, up_to_age, source): the best range of each outcome and gene.

    Rows of actionable verdicts only; of equal ranges the first by ``order`` gives age and source. Places go by high,
    low, outcome and gene, all descending.
    """
    rows = verdicts.where(actionable(F.col("tier"))).select(sample, "gene", order, F.explode("cancer_risks").alias("r")).select(sample, "gene", order, "r.*")
    best = best_ranges(rows, [sample, "outcome", "gene"], order, ["up_to_age", "source"])
    place = F.row_number().over(Window.partitionBy(sample).orderBy(*[F.desc(c) for c in ("risk_high_pct", "risk_low_pct", "outcome", "gene")]))
    return best.select(sample, place.alias("place"), "outcome", "gene", F.col("risk_low_pct").alias("low"), F.col("risk_high_pct").alias("high"), risk_range(F.col("risk_low_pct"), F.col("risk_high_pct")).alias("range"), "up_to_age", "source")


def display_rows(verdicts: DataFrame, order: str, sample: str = "sample_id", most: int = 20, benign: int = 10) -> DataFrame:
    """``verdicts`` as a report shows them, with ``place`` and ``omitted``.

    A sample of up to ``most`` verdicts is shown whole; of a larger one all that aren't benign come first, then the first
    ``benign`` of the benign ones, and ``omitted`` tells how many of those are left out. This limit is the display's.
    """
    is_benign = F.coalesce(F.col("tier").isin(*BENIGN), F.lit(False))
    own = Window.partitionBy(sample)
    counted = verdicts.withColumns({"_benign": is_benign, "_n": F.count("*").over(own), "_b": F.count_if(is_benign).over(own)})
    ranked = counted.withColumn("_r", F.row_number().over(Window.partitionBy(sample, "_benign").orderBy(order)))
    shown = ranked.where((F.col("_n") <= most) | ~F.col("_benign") | (F.col("_r") <= benign))
    first = F.when(F.col("_n") > most, F.col("_benign")).otherwise(F.lit(False))
    place = F.row_number().over(Window.partitionBy(sample).orderBy(first, order))
    omitted = F.when(F.col("_n") > most, F.greatest(F.col("_b") - benign, F.lit(0))).otherwise(0)
    return shown.withColumns({"place": place, "omitted": omitted.cast("bigint")}).drop("_benign", "_n", "_b", "_r")


def sample_totals(verdicts: DataFrame, sample: str = "sample_id") -> DataFrame:
    return verdicts.groupBy(sample).agg(F.count("*").alias("total"), F.count_if(actionable(F.col("tier"))).alias("actionable"))


def _verdict_lines(columns: list[str]) -> Column:
    """The lines of one verdict: call and tier, evidence, score, notes, and of an actionable one its risks and other features."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    place = F.concat(F.lit("VARIANT #"), F.col("_n"), F.lit(": "), F.col("gene"), F.lit(" chr"), F.col("chrom"), F.lit(":"), F.col("pos"), F.lit(" "), F.col("ref"), F.lit(">"), F.col("alt"))
    call = F.concat(F.lit("Genotype: "), text("gt"), F.lit(" (DP="), text("dp"), F.lit(", GQ="), text("gq"), F.lit(")"))
    tier = F.concat(F.lit("VERDICT TIER: ["), F.upper("tier"), F.lit("] "), F.col("source"))
    shown = display_annotation(F.col("hgvs_p"), F.col("hgvs_c"), F.col("consequence"))
    lines = [F.concat_ws("  ", place, shown, call, tier), F.concat(F.lit("Evidence: "), F.col("source"))]
    if "model_score" in columns:
        lines.append(F.when(F.col("model_score").isNotNull(), F.format_string("Calibrated score: %.4f", F.col("model_score").cast("double"))))
    if "notes" in columns:
        lines.append(F.when(F.trim("notes") != "", F.concat(F.lit("Notes: "), F.trim("notes"))))
    range_ = lambda r: F.concat(r["outcome"], F.lit(": "), risk_range(r["risk_low_pct"], r["risk_high_pct"]), F.lit(" (up to age "), r["up_to_age"], F.lit(")"))
    risk = lambda r: F.concat(range_(r), F.lit(" [Source: "), F.coalesce(r["source"], F.lit("-")), F.lit(", Evidence: "), F.coalesce(r["evidence_level"], F.lit("-")), F.lit("]"))
    other = lambda r: F.concat(range_(r), F.lit(" [Source: "), F.coalesce(r["source"], F.lit("-")), F.lit("]"))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    none = F.array(F.lit("No curated lifetime risk estimate available for this gene."))
    parts = [F.array(*lines), F.when(actionable(F.col("tier")), F.when(some("cancer_risks"), F.transform("cancer_risks", risk)).otherwise(none))]
    if "other_risks" in columns:
        parts.append(F.when(actionable(F.col("tier")) & some("other_risks"), F.concat(F.array(F.lit("Other features, not cancer:")), F.transform("other_risks", other))))
    return F.filter(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]), lambda x: x.isNotNull())


def report_lines(verdicts: DataFrame, order: str, sample: str = "sample_id") -> DataFrame:
    """(sample, section, number, line): totals, risk table, the lines of each verdict in file order, the disclaimer.

    Sections are numbered 0 to 3; write them sorted by (section, number), partitioned by sample. No sample is gathered
    in one row. The verdicts are written first, as four parts read them; without model_score, notes or other_risks their
    lines are left out.
    """
    verdicts = written(verdicts, "verdicts")
    made = lambda df, section, number, line: df.select(sample, F.lit(section).alias("section"), number.cast("bigint").alias("number"), line.alias("line"))
    totals = sample_totals(verdicts, sample)
    told = F.array(
        F.struct(F.lit(0).alias("section"), F.lit(1).alias("number"), F.format_string("TOTAL PANEL VARIANTS EVALUATED: %d", "total").alias("line")),
        F.struct(F.lit(0).alias("section"), F.lit(2).alias("number"), F.format_string("ACTIONABLE (PATHOGENIC / LIKELY PATHOGENIC): %d", "actionable").alias("line")),
        F.struct(F.lit(3).alias("section"), F.lit(1).alias("number"), F.lit(DISCLAIMER).alias("line")),
    )
    ends = totals.select(sample, F.explode(told).alias("t")).select(sample, "t.section", F.col("t.number").cast("bigint").alias("number"), "t.line")
    risks = risk_table(verdicts, order, sample)
    table = made(risks, 1, F.col("place"), F.concat_ws(" | ", F.rpad("outcome", 32, " "), F.rpad("range", 23, " "), F.rpad("gene", 16, " "), F.format_string("Up to age %d", "up_to_age")))
    numbered = verdicts.withColumn("_n", F.row_number().over(Window.partitionBy(sample).orderBy(order)))
    each = numbered.select(sample, "_n", F.posexplode(_verdict_lines(verdicts.columns)).alias("_i", "line"))
    return ends.unionByName(table).unionByName(made(each, 2, F.col("_n") * 1000 + F.col("_i"), F.col("line")))


def report_json(verdicts: DataFrame, order: str, sample: str = "sample_id") -> DataFrame:
    """(sample, value): one JSON document a sample with totals, risk summary, verdicts in file order and disclaimer.

    A document holds all verdicts of one sample by its nature; use ``report_lines`` where samples are too large for a row.
    """
    risks = risk_table(verdicts, order, sample)
    entry = F.struct("place", F.col("outcome").alias("cancer_type"), F.col("range").alias("lifetime_risk_range"), F.array("gene").alias("genes"), "up_to_age", "source")
    summary = risks.groupBy(sample).agg(F.sort_array(F.collect_list(entry)).alias("_s")).select(sample, F.transform("_s", lambda x: x.dropFields("place")).alias("cancer_risk_summary"))
    rest = [c for c in verdicts.columns if c not in (sample, order)]
    gathered = verdicts.groupBy(sample).agg(F.count("*").alias("total_variants"), F.count_if(actionable(F.col("tier"))).alias("actionable_count"), F.sort_array(F.collect_list(F.struct(F.col(order), F.struct(*rest).alias("v")))).alias("_v"))
    whole = gathered.join(summary, sample, "left")
    body = F.struct("total_variants", "actionable_count", F.coalesce("cancer_risk_summary", F.array().cast(summary.schema["cancer_risk_summary"].dataType)).alias("cancer_risk_summary"), F.transform("_v", lambda x: x["v"]).alias("verdicts"), F.lit(DISCLAIMER).alias("disclaimer"))
    return whole.select(sample, F.to_json(body).alias("value"))
