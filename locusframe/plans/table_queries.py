"""Registered queries of the extraction job, group statistics, set comparisons and the legacy expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.functions import features, legacy
from locusframe.operators import aggregates, annotate, extraction, metrics, quality
from locusframe.plans.bindings import bound, with_tables
from locusframe.plans.queries import query
from locusframe.sources.shared import written

PANEL = ["AB1", "BRCA1", "CD2"]
_DUMP = """dump AS (SELECT ord, chrom, pos, ref, CASE WHEN dp = 7 THEN 'NA' WHEN dp = 8 THEN ref WHEN dp = 9 THEN alt || 'A' ELSE alt END AS alt,
 CASE WHEN gene IN ('G1', 'G2') THEN 'ZZ9' WHEN gene = 'G4' THEN 'AB1;CD2' WHEN gene = 'G5' THEN 'ZZ9;AB1' ELSE 'CD2' END AS symbols,
 CASE WHEN gt = '0/0' THEN 'GRCh37' ELSE 'GRCh38' END AS assembly, CASE WHEN af_milli = 3 THEN 'somatic' ELSE 'germline/somatic' END AS origin,
 CASE consequence WHEN 'missense' THEN 'Pathogenic' WHEN 'intron' THEN 'Uncertain significance' WHEN 'frameshift' THEN 'Conflicting classifications of pathogenicity' ELSE 'Likely benign' END AS significance,
 CASE WHEN gq < 20 THEN 'no assertion criteria provided' ELSE 'reviewed by expert panel' END AS review,
 CASE WHEN splice_pct < 10 THEN 'NM_1.2(AB1):c.5A>G (p.Lys5Arg)' WHEN splice_pct < 60 THEN 'NM_1.2(CD2):c.10+1T>A' ELSE 'NM_3.1(CD2):c.77G>A' END AS name FROM calls)"""
_REASON = """reasons AS (SELECT *, CASE WHEN symbols = 'ZZ9' THEN 'not_in_panel' WHEN symbols = 'AB1;CD2' THEN 'ambiguous_gene' WHEN assembly <> 'GRCh38' THEN 'assembly' WHEN origin = 'somatic' THEN 'origin' WHEN alt = 'NA' THEN 'no_alleles'
 WHEN ref = alt THEN 'same_alleles' WHEN length(alt) > 1 THEN 'not_snv' WHEN significance IN ('Pathogenic', 'Likely benign') AND review LIKE 'no %' THEN 'low_stars'
 WHEN (symbols = 'CD2') <> (name LIKE '%(CD2)%') THEN 'foreign_gene' ELSE 'kept' END AS stage FROM dump)"""


def dump(spark, sf_dir):
    """A registry dump's columns, derived from the calls."""
    return spark.sql(f"WITH {_DUMP.replace('FROM calls', 'FROM {calls}')} SELECT * FROM dump", calls=bound(spark, sf_dir, "calls"))


@query(f"{with_tables('calls')}, {_DUMP}, {_REASON}, c AS (SELECT stage, count(*) AS dropped, list_position({extraction.STAGES}, stage) AS o FROM reasons GROUP BY 1) SELECT stage, dropped, CASE stage WHEN 'kept' THEN dropped ELSE coalesce(sum(dropped) OVER (ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) END::bigint AS left FROM c".replace(" AS left ", ' AS "left" '))
def extraction_funnel(spark, sf_dir):
    return extraction.funnel(dump(spark, sf_dir), PANEL)


@query(f"""{with_tables('calls')}, {_DUMP}, {_REASON}, k AS (SELECT *, CASE symbols WHEN 'CD2' THEN 'CD2' ELSE 'AB1' END AS gene FROM reasons WHERE stage = 'kept'),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt, gene ORDER BY ord) AS rn FROM k) WHERE rn = 1),
t AS (SELECT gene, split_part(name, '(', 1) AS tx, row_number() OVER (PARTITION BY gene ORDER BY count(*) DESC, min(CASE WHEN significance LIKE 'Unc%' THEN 1000000000000000000 ELSE 0 END + ord)) AS rn FROM f WHERE significance NOT LIKE 'Conf%' GROUP BY 1, 2),
c AS (SELECT gene, count(*) FILTER (significance = 'Pathogenic') AS pathogenic, count(*) FILTER (significance = 'Likely benign') AS benign, count(*) FILTER (significance LIKE 'Unc%') AS uncertain, count(*) FILTER (significance LIKE 'Conf%') AS conflicting FROM f GROUP BY 1)
SELECT p.gene, coalesce(pathogenic, 0) AS pathogenic, coalesce(benign, 0) AS benign, coalesce(uncertain, 0) AS uncertain, coalesce(conflicting, 0) AS conflicting, tx AS primary_transcript, coalesce(pathogenic + benign, 0) < 30 AS is_sparse
FROM (SELECT unnest({PANEL}) AS gene) p LEFT JOIN c ON p.gene = c.gene LEFT JOIN t ON p.gene = t.gene AND rn = 1""")
def extraction_manifest(spark, sf_dir):
    panel = spark.createDataFrame([(g,) for g in PANEL], "gene string")
    return extraction.gene_manifest(written(extraction.extract(dump(spark, sf_dir), PANEL, "ord"), "extracted"), panel, "ord")  # read three times


@query(f"{with_tables('predictions')} SELECT class, count(*) AS n, count(*) FILTER (label = 1) AS positives, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::double AS pct FROM predictions GROUP BY 1")
def class_distribution(spark, sf_dir):
    return aggregates.class_distribution(bound(spark, sf_dir, "predictions"), "class", "label").withColumn("pct", F.round("pct", 4))


@query(f"{with_tables('calls')} SELECT gene, chrom, min(pos) AS start, max(pos) AS stop, count(*) AS n FROM calls GROUP BY 1, 2")
def group_extent(spark, sf_dir):
    return aggregates.extents(bound(spark, sf_dir, "calls"), ["gene", "chrom"])


@query(f"{with_tables('predictions')} SELECT CASE WHEN score >= 0.9 THEN 'Pathogenic' WHEN score >= 0.7 THEN 'Likely Pathogenic' WHEN score >= 0.3 THEN 'VUS' WHEN score >= 0.1 THEN 'Likely Benign' ELSE 'Benign' END AS tier, count(*) AS n, round(avg(label), 6) AS rate FROM predictions GROUP BY 1")
def observed_rates(spark, sf_dir):
    p = bound(spark, sf_dir, "predictions")
    return p.groupBy(features.score_tier(F.col("score")).alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("rate"))


@query(f"{with_tables('calls', 'registry')}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY ord DESC) AS rn FROM registry) WHERE rn = 1) SELECT count(*) - count(c.ord) AS ord, count(*) - count(stars) AS stars, count(*) - count(significance) AS significance FROM calls c LEFT JOIN l ON c.chrom = l.chrom AND c.pos = l.pos AND c.ref = l.ref AND c.alt = l.alt")
def null_audit(spark, sf_dir):
    found = annotate.registry_lookup(bound(spark, sf_dir, "calls"), bound(spark, sf_dir, "registry").withColumnRenamed("ord", "r_ord"), "r_ord")
    return aggregates.null_audit(found.select("ord", "stars", "significance"))


@query(f"{with_tables('calls')} SELECT gene, greatest(coalesce(max(pos) FILTER (consequence = 'missense' AND dp > 48), max(pos), 1000), 100) AS pos FROM calls GROUP BY 1")
def max_with_fallback(spark, sf_dir):
    return aggregates.max_with_fallback(bound(spark, sf_dir, "calls"), "gene", "pos", (F.col("consequence") == "missense") & (F.col("dp") > 48), 1000)


@query(f"{with_tables('predictions')} SELECT round(count(*) FILTER (label = 0) / count(*) FILTER (label = 1), 6) AS weight FROM predictions")
def imbalance_weight(spark, sf_dir):
    return aggregates.imbalance_weight(bound(spark, sf_dir, "predictions"), "label").select(F.round("weight", 6).alias("weight"))


@query(f"{with_tables('calls')}, c AS (SELECT gene, consequence, count(*) AS n, min(ord) AS f FROM calls GROUP BY 1, 2), p AS (SELECT gene, consequence AS best FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1) SELECT c.gene, count(*) AS kinds, coalesce(sum(n) FILTER (consequence <> best), 0)::bigint AS off FROM c JOIN p ON c.gene = p.gene GROUP BY 1 HAVING count(*) > 1".replace(" AS off ", ' AS "off" '))
def off_primary(spark, sf_dir):
    return aggregates.off_primary(bound(spark, sf_dir, "calls"), "gene", "consequence", "ord")


_SNAPSHOT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY ord) AS rn FROM registry WHERE ord % 3 <> {r}) WHERE rn = 1)"


@query(f"{with_tables('registry')}, a AS {_SNAPSHOT.format(r=0)}, b AS {_SNAPSHOT.format(r=1)} SELECT count(*) FILTER (a.ord IS NOT NULL AND b.ord IS NOT NULL) AS shared, count(*) FILTER (b.ord IS NULL) AS only_old, count(*) FILTER (a.ord IS NULL) AS only_new, count(*) FILTER (a.significance = b.significance) AS significance_same, count(*) FILTER (a.stars = b.stars) AS stars_same FROM a FULL JOIN b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt")
def snapshot_agreement(spark, sf_dir):
    r = bound(spark, sf_dir, "registry")
    old, new = (aggregates.keep_first(r.where(f"ord % 3 <> {n}"), annotate.KEY, "ord") for n in (0, 1))
    return aggregates.snapshot_agreement(old, new, annotate.KEY, ["significance", "stars"])


@query(f"{with_tables('calls')}, d AS (SELECT sample_id, gene, dp < lag(dp) OVER (PARTITION BY sample_id, gene ORDER BY pos, ord) AS down FROM calls) SELECT sample_id, gene, count(*) FILTER (down) AS breaks FROM d GROUP BY 1, 2")
def order_breaks(spark, sf_dir):
    return aggregates.order_breaks(bound(spark, sf_dir, "calls"), ["sample_id", "gene"], ["pos", "ord"], "dp")


@query(f"{with_tables('calls', 'registry')}, a AS (SELECT DISTINCT chrom, pos FROM calls), b AS (SELECT DISTINCT chrom, pos FROM registry) SELECT 'calls_only' AS part, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def set_operations(spark, sf_dir):
    a, b = (bound(spark, sf_dir, t).select("chrom", "pos") for t in ("calls", "registry"))
    parts = {"calls_only": a.subtract(b), "both": a.intersect(b), "either": a.unionByName(b).distinct()}
    return quality.suite([rows.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, rows in parts.items()])


@query(f"{with_tables('penetrance')} SELECT gene, outcome, count(*) OVER (PARTITION BY outcome) AS n FROM penetrance")
def outcome_multiplicity(spark, sf_dir):
    p = bound(spark, sf_dir, "penetrance")
    return p.select("gene", "outcome").join(p.groupBy("outcome").agg(F.count("*").alias("n")), "outcome")


_RANKED = "SELECT key, label, 'score' AS feature, score AS v FROM predictions UNION ALL SELECT key, label, 'flipped', 1 - score FROM predictions UNION ALL SELECT key, label, 'key', (key % 17)::double FROM predictions"


@query(f"{with_tables('predictions')}, l AS ({_RANKED}), s AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rk FROM l) SELECT feature, round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM s GROUP BY 1")
def single_feature_auc(spark, sf_dir):
    long = bound(spark, sf_dir, "predictions").selectExpr("label", "stack(3, 'score', cast(score AS double), 'flipped', 1 - cast(score AS double), 'key', cast(key % 17 AS double)) AS (feature, v)")
    return metrics.ranking(long, "v", "label", ["feature"]).select("feature", F.round("auc", 6).alias("auc"))


@query(f"{with_tables('calls')}, c AS (SELECT ord, ref || alt || substr('ACGTN', dp % 5 + 1, 1) AS codon FROM calls) SELECT ord, CASE WHEN codon LIKE '%N' THEN 'X' ELSE substr('{legacy.CODON_AMINO_ACIDS}', ((strpos('TCAG', codon[1]) - 1) * 16 + (strpos('TCAG', codon[2]) - 1) * 4 + strpos('TCAG', codon[3]))::int, 1) END AS amino FROM c")
def codon_translation(spark, sf_dir):
    codon = F.concat("ref", "alt", F.substring(F.lit("ACGTN"), F.col("dp") % 5 + 1, F.lit(1)))
    return bound(spark, sf_dir, "calls").select("ord", legacy.translate_codon(codon).alias("amino"))


@query(f"{with_tables('calls')} SELECT ord, CASE WHEN splice_pct >= 85 THEN 'high' WHEN splice_pct >= 50 THEN 'moderate_high' WHEN splice_pct >= 20 THEN 'uncertain' ELSE 'low' END AS band, CASE WHEN dp * 3 >= 100 THEN 'radical' WHEN dp * 3 >= 50 THEN 'moderate' ELSE 'conservative' END AS exchange, round(least(99.0, greatest(dp * 0.15, dp * (splice_pct / 100.0)))::double, 6) AS organ_risk, CASE WHEN gq < 40 THEN 0.0 ELSE least(9.999, round(round(1 / greatest(100.0, dp * 750.0)::double, 6) * greatest(30.0, dp * 250.0)::double, 3)) END::double AS ratio FROM calls")
def legacy_bands(spark, sf_dir):
    rates = legacy.substitution_rates(F.col("gq") < 40, F.col("dp") * 1000.0)
    risk = legacy.organ_risk(F.col("splice_pct") / 100.0, F.col("dp").cast("double"))
    return bound(spark, sf_dir, "calls").select("ord", legacy.risk_band(F.col("splice_pct")).alias("band"), legacy.exchange_severity(F.col("dp") * 3).alias("exchange"), F.round(risk, 6).alias("organ_risk"), rates["ratio"].alias("ratio"))


@query("WITH p AS (SELECT text, doc_id * 37 % 400 AS p, substr('aeiou*', (doc_id % 6 + 1)::int, 1) AS r FROM documents), s AS (SELECT CASE WHEN text IS NULL THEN 'missing' WHEN r = '*' AND p = length(text) + 1 THEN 'stop_site' WHEN p < 1 OR p > length(text) THEN 'out_of_bounds' WHEN substr(text, p, 1) = r THEN 'matched' ELSE 'mismatch' END AS status FROM p) SELECT status, count(*) AS n FROM s GROUP BY 1")
def sequence_summary(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"p": (F.col("doc_id") * 37 % 400).cast("int"), "r": F.substring(F.lit("aeiou*"), (F.col("doc_id") % 6 + 1).cast("int"), F.lit(1))})
    return d.groupBy(features.residue_status(F.col("text"), F.col("p"), F.col("r")).alias("status")).agg(F.count("*").alias("n"))
