"""Registered queries of the VCF job, reports, the feature table, checks against names, and the evaluation job."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from locusframe.functions import features, legacy
from locusframe.operators import aggregates, annotate, evaluation, featurised, metrics, quality, report, splits, vcf_job
from locusframe.plans.bindings import bound, with_tables
from locusframe.plans.queries import _RISKED, _STATES, _risks, query
from locusframe.sources.shared import written

PANEL = [f"G{i}" for i in range(20)]
RECESSIVE = ["G3", "G7"]
_IN = ", ".join(f"'{g}'" for g in PANEL)
_NAMED = f"""{with_tables('sites', 'known', 'places')}, kept AS (SELECT *, row_number() OVER () AS k FROM sites WHERE filter = 'PASS' AND dp >= 10 AND gq >= 20 AND gt <> '0/0'),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY ord DESC) AS rn FROM known) WHERE rn = 1),
a AS (SELECT s.*, r.gene AS r_gene, r.significance, r.stars, CASE WHEN kind IN (0, 5) AND told IN ({_IN}) THEN 'csq' WHEN kind = 1 AND told IN ({_IN}) THEN 'ann' WHEN r.gene IS NOT NULL THEN 'registry' END AS src
 FROM kept s LEFT JOIN r ON s.chrom = r.chrom AND s.pos = r.pos AND s.ref = r.ref AND s.alt = r.alt),
i AS (SELECT a.k, CASE WHEN count(p.gene) = 1 THEN min(p.gene) END AS p_gene FROM a LEFT JOIN places p ON a.chrom = p.chrom AND a.pos BETWEEN p.start AND p.stop WHERE src IS NULL GROUP BY 1),
n AS (SELECT a.*, coalesce(src, CASE WHEN p_gene IS NOT NULL THEN 'interval' END) AS gene_source, CASE WHEN src IN ('csq', 'ann') THEN told WHEN src = 'registry' THEN r_gene ELSE p_gene END AS gene,
 CASE WHEN src IN ('csq', 'ann') THEN told_consequence WHEN src = 'registry' THEN 'missense' WHEN p_gene IS NOT NULL THEN 'intronic' END AS consequence FROM a LEFT JOIN i ON a.k = i.k)"""
_JOB = f"""{_NAMED}, v AS (SELECT *, line AS ord, splice_pct / 100.0 AS splice, CASE WHEN af_milli > 10 THEN 'frequency' WHEN stars >= 2 THEN 'registry' WHEN consequence IN ('frameshift', 'splice_donor') THEN 'loss_of_function'
 WHEN splice_pct >= 20 THEN 'splice' WHEN consequence = 'splice_region' AND NOT (gene_source = 'csq' AND kind = 0) THEN 'splice_region' ELSE 'unresolved' END AS source FROM n WHERE gene IN ({_IN})),
w AS (SELECT *, CASE source WHEN 'frequency' THEN 'Benign' WHEN 'registry' THEN CASE significance WHEN 'Pathogenic' THEN 'Pathogenic' WHEN 'Likely benign' THEN 'Likely Benign' ELSE 'VUS' END WHEN 'loss_of_function' THEN 'Likely Pathogenic'
 WHEN 'splice' THEN CASE WHEN splice >= 0.5 THEN 'Likely Pathogenic' ELSE 'VUS' END WHEN 'splice_region' THEN 'VUS' ELSE 'Unscored' END AS tier FROM v),
held AS (SELECT * FROM w WHERE tier IN ('Pathogenic', 'Likely Pathogenic') AND gt <> '1/1' AND gene IN ('G3', 'G7')), {_STATES.format(rows='held')},
final AS (SELECT w.*, CASE WHEN w.tier IN ('Pathogenic', 'Likely Pathogenic') AND gt <> '1/1' AND w.gene IN ('G3', 'G7') AND state <> 'trans' THEN 'Carrier (Recessive)' ELSE w.tier END AS final_tier FROM w LEFT JOIN states s ON w.sample_id = s.sample_id AND w.gene = s.gene)"""


def reference(spark, sf_dir):
    penetrance = bound(spark, sf_dir, "penetrance").withColumns({"source": F.lit("s"), "evidence_level": F.lit("e")})
    known = annotate.lay_out_registry(bound(spark, sf_dir, "known"), f"registry_{uuid.uuid4().hex}", "ord", 8)
    return vcf_job.Reference(known, bound(spark, sf_dir, "places").withColumnRenamed("stop", "end"), penetrance, PANEL, RECESSIVE)


def job_calls(spark, sf_dir):
    """The sites as a reader would give them (a stored table: their texts are made once), through the job's filters and allele split."""
    s = written(bound(spark, sf_dir, "sites"), "sites")
    sites = s.select("sample_id", "line", "chrom", "pos", "ref", F.array("alt").alias("alts"), "filter", "info", F.lit("GT:DP:GQ").alias("format"), F.concat_ws(":", "gt", F.col("dp").cast("string"), F.col("gq").cast("string")).alias("sample"))
    return vcf_job.calls_of(sites)


@query(f"{_NAMED} SELECT line, gene, gene_source, consequence FROM n")
def gene_attribution(spark, sf_dir):
    held = reference(spark, sf_dir)
    calls = job_calls(spark, sf_dir).select(*vcf_job.CALL, *annotate.KEY, "n_alts", "info")  # genes need no frequency or splice score
    return annotate.attribute_genes(calls, held.registry, held.intervals, PANEL, vcf_job.CALL, "ord").select("line", "gene", "gene_source", "consequence")


@query(f"{_JOB} SELECT sample_id, gene, final_tier AS tier, source, count(*) AS n FROM final GROUP BY 1, 2, 3, 4")
def vcf_job_verdicts(spark, sf_dir):
    return vcf_job.interpret_calls(job_calls(spark, sf_dir), reference(spark, sf_dir)).groupBy("sample_id", "gene", "tier", "source").agg(F.count("*").alias("n"))


@query(f"{_RISKED}, b AS (SELECT sample_id, outcome, f.gene, max(risk_low_pct) AS low, max(risk_high_pct) AS high, max(up_to_age) AS up_to_age FROM final f JOIN penetrance p ON f.gene = p.gene WHERE final_tier IN ('Pathogenic', 'Likely Pathogenic') GROUP BY 1, 2, 3) SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY high DESC, low DESC, outcome DESC, gene DESC) AS place, outcome, gene, low, high, low::bigint || '% - ' || high::bigint || '%' AS \"range\", up_to_age FROM b")
def report_risk_table(spark, sf_dir):
    return report.risk_table(_risks(spark, sf_dir), "ord").select("sample_id", F.col("place").cast("bigint").alias("place"), "outcome", "gene", "low", "high", "range", "up_to_age")


@query(f"""{_RISKED}, b AS (SELECT sample_id, outcome, f.gene FROM final f JOIN penetrance p ON f.gene = p.gene WHERE final_tier IN ('Pathogenic', 'Likely Pathogenic') GROUP BY 1, 2, 3),
t AS (SELECT sample_id, count(*) AS n, count(*) FILTER (final_tier IN ('Pathogenic', 'Likely Pathogenic')) AS a FROM final GROUP BY 1),
v AS (SELECT sample_id, 'VARIANT #' || row_number() OVER (PARTITION BY sample_id ORDER BY ord) || ': ' || gene || ' chr' || chrom || ':' || pos || ' ' || ref || '>' || alt || '  ' || consequence || '  Genotype: ' || gt || ' (DP=' || dp || ', GQ=' || gq || ')  VERDICT TIER: [' || upper(final_tier) || '] ' || source AS line FROM final),
k AS (SELECT f.sample_id, coalesce(p.outcome || ': ' || p.risk_low_pct::bigint || '% - ' || p.risk_high_pct::bigint || '% (up to age ' || p.up_to_age || ') [Source: s, Evidence: e]', 'No curated lifetime risk estimate available for this gene.') AS line FROM final f LEFT JOIN penetrance p ON f.gene = p.gene WHERE final_tier IN ('Pathogenic', 'Likely Pathogenic')),
e AS (SELECT sample_id, 'Evidence: ' || source AS line FROM final UNION ALL SELECT sample_id, 'Calibrated score: ' || printf('%.4f', (CASE source WHEN 'frequency' THEN 0.001 WHEN 'registry' THEN CASE tier WHEN 'Pathogenic' THEN 0.999 WHEN 'Likely Benign' THEN 0.05 ELSE 0.5 END WHEN 'loss_of_function' THEN 0.95 WHEN 'splice' THEN CASE tier WHEN 'VUS' THEN 0.5 ELSE 0.95 END WHEN 'splice_region' THEN 0.4 ELSE 0 END)::double) FROM final)
SELECT sample_id, 0 AS section, 2::bigint AS n, 'ACTIONABLE (PATHOGENIC / LIKELY PATHOGENIC): ' || a AS first_line, 'TOTAL PANEL VARIANTS EVALUATED: ' || n AS last_line FROM t
UNION ALL SELECT b.sample_id, 1, count(*), min(rpad(b.outcome, 32, ' ') || ' | ' || rpad(p.risk_low_pct::bigint || '% - ' || p.risk_high_pct::bigint || '%', 23, ' ') || ' | ' || rpad(b.gene, 16, ' ') || ' | Up to age ' || p.up_to_age), max(rpad(b.outcome, 32, ' ') || ' | ' || rpad(p.risk_low_pct::bigint || '% - ' || p.risk_high_pct::bigint || '%', 23, ' ') || ' | ' || rpad(b.gene, 16, ' ') || ' | Up to age ' || p.up_to_age) FROM b JOIN penetrance p ON b.gene = p.gene AND b.outcome = p.outcome GROUP BY 1
UNION ALL SELECT sample_id, 2, count(*), min(line), max(line) FROM (SELECT * FROM v UNION ALL SELECT * FROM k UNION ALL SELECT * FROM e) GROUP BY 1
UNION ALL SELECT sample_id, 3, 1, '{report.DISCLAIMER}', '{report.DISCLAIMER}' FROM t""")
def report_sections(spark, sf_dir):
    """The text report's sections: lines, the least and the greatest of them."""
    rows = _risks(spark, sf_dir).withColumns({"hgvs_p": F.lit(""), "hgvs_c": F.lit(".")})
    return report.report_lines(rows, "ord").groupBy("sample_id", "section").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


#: Residue properties of a test panel.
_RESIDUES = [("K", 146.19, 1.0, -3.05, 89.34), ("R", 174.2, 1.0, -4.2, 125.22), ("D", 133.1, -1.0, -3.5, 100.62), ("W", 204.23, 0.0, -1.05, 79.11), ("M", 149.21, 0.0, -1.87, 88.62)]
_PAIRS = [(a[0], b[0], float(10 * i + j), 0.0 if i == j else 0.125 * (i + j)) for i, a in enumerate(_RESIDUES) for j, b in enumerate(_RESIDUES)]
_VALUES = "res(aa, mw, charge, logp, tpsa) AS (VALUES " + ", ".join(map(str, _RESIDUES)) + "), prs(ref_aa, alt_aa, distance, unlike) AS (VALUES " + ", ".join(map(str, _PAIRS)) + ")"
_DELTA = "round(CASE WHEN variant_class = 'start_lost' THEN {start} WHEN variant_class = 'stop_lost' THEN coalesce(q.{c}, 0) WHEN ex THEN round(q.{c} - p.{c}, 3) WHEN st THEN coalesce(-p.{c}, 0) ELSE 0 END, 6)::double AS delta_{c}"


@query(f"""{with_tables('variants')}, {_VALUES}, k AS (SELECT v.*, ref_aa IN ('K', 'R', 'D', 'W', 'M') AND alt_aa IN ('K', 'R', 'D', 'W', 'M') AND variant_class NOT IN ('start_lost', 'stop_lost') AS ex, (ref_aa = '*' OR alt_aa = '*' OR variant_class = 'nonsense') AND variant_class NOT IN ('start_lost', 'stop_lost') AS st,
 CASE WHEN cast(substr(gene, 2) AS int) < 20 THEN 20 ELSE 1000 END AS len FROM variants v)
SELECT ord, (variant_class IN ('start_lost', 'stop_lost') OR ex OR st)::int AS has_protein_change, round(CASE WHEN variant_class = 'start_lost' OR NOT (variant_class = 'stop_lost' OR ex OR st) THEN 0 WHEN aa_pos <= 0 THEN CASE WHEN variant_class = 'stop_lost' THEN 1 ELSE 0 END ELSE least(1.0, aa_pos / len) END, 6)::double AS rel_protein_pos,
 CASE WHEN variant_class = 'start_lost' THEN 215 WHEN variant_class = 'stop_lost' OR (st AND NOT ex) THEN 200 WHEN ex THEN coalesce(distance, 100) ELSE 0 END::double AS severity,
 CASE WHEN variant_class IN ('start_lost', 'stop_lost') OR (st AND NOT ex) THEN 1 WHEN ex AND k.ref_aa <> k.alt_aa THEN unlike ELSE 0 END::double AS dissimilarity, {', '.join(_DELTA.format(c=c, start='-149.21' if c == 'mw' else '0') for c in featurised.PROPERTIES)},
 (ref || alt IN ('AG', 'GA', 'CT', 'TC'))::int AS is_transition, CASE variant_class WHEN 'synonymous' THEN 0 WHEN 'missense' THEN 1 WHEN 'nonsense' THEN 2 WHEN 'start_lost' THEN 3 WHEN 'stop_lost' THEN 4 WHEN 'intronic' THEN 7 ELSE 10 END AS variant_class_id, (ref = 'A')::int AS \"ref_A\", (CASE WHEN cast(substr(gene, 2) AS int) % 2 = 1 AND cast(substr(gene, 2) AS int) < 20 THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END = 'G')::int AS \"cs_alt_G\"
FROM k LEFT JOIN res p ON k.ref_aa = p.aa LEFT JOIN res q ON k.alt_aa = q.aa LEFT JOIN prs ON k.ref_aa = prs.ref_aa AND k.alt_aa = prs.alt_aa""")
def featurised_table(spark, sf_dir):
    v = bound(spark, sf_dir, "variants")
    number = F.substring("gene", 2, 9).cast("int")
    genes = v.select("gene").distinct().where(number < 20).select("gene", F.when(number % 2 == 1, "-").otherwise("+").alias("strand"), F.lit(20).alias("length"))
    residues = spark.createDataFrame(_RESIDUES, "aa string, mw double, charge double, logp double, tpsa double")
    pairs = spark.createDataFrame(_PAIRS, "ref_aa string, alt_aa string, distance double, dissimilarity double")
    made = featurised.featurise(v.select("ord", "gene", "ref", "alt", "variant_class", "ref_aa", "alt_aa", "aa_pos"), genes, residues, pairs, "default")
    rounded = [F.round(c, 6).alias(c) for c in ("rel_protein_pos", "delta_mw", "delta_charge", "delta_logp", "delta_tpsa")]
    return made.select("ord", "has_protein_change", *rounded, "severity", "dissimilarity", "is_transition", "variant_class_id", "ref_A", "cs_alt_G")


_CACHE = "cache AS (SELECT gene, aa_pos, min(dp_score) AS s FROM (SELECT gene, aa_pos, (aa_pos % 7) / 10.0 AS dp_score FROM variants WHERE aa_pos % 3 <> 0) GROUP BY 1, 2)"


@query(f"{with_tables('variants')}, {_CACHE} SELECT ord, CASE WHEN s IS NOT NULL AND ref_aa IN ('K', 'R', '*') AND alt_aa IN ('K', 'R', '*') THEN round(((alt_aa = 'R')::int * s - (alt_aa = '*')::int) - ((ref_aa = 'R')::int * s - (ref_aa = '*')::int), 6) ELSE 0 END::double AS llr, (s IS NOT NULL AND ref_aa IN ('K', 'R', '*') AND alt_aa IN ('K', 'R', '*'))::int AS available, (s IS NOT NULL)::int AS has_scores, CASE WHEN s IS NULL THEN 0 ELSE 2 END::double AS norm FROM variants v LEFT JOIN cache c ON v.gene = c.gene AND v.aa_pos = c.aa_pos")
def score_cache_lookup(spark, sf_dir):
    v = bound(spark, sf_dir, "variants")
    s = (F.col("aa_pos") % 7) / 10.0
    cache = v.where("aa_pos % 3 <> 0").groupBy("gene", "aa_pos").agg(F.count("*").alias("n"))
    cache = cache.select("gene", "aa_pos", F.create_map(F.lit("K"), F.lit(0.0), F.lit("R"), s, F.lit("*"), F.lit(-1.0)).alias("scores"), F.array_repeat(F.lit(0.5), 4).alias("embedding"))
    found = annotate.score_lookup(v, cache, 4).withColumn("m", features.masked_llr(F.col("scores"), F.col("ref_aa"), F.col("alt_aa")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return found.select("ord", F.round("m.llr", 6).alias("llr"), "m.available", "has_scores", norm.alias("norm"))


@query(f"{with_tables('variants')}, s AS (SELECT ord, CASE WHEN gene = 'G1' THEN 'missing' WHEN ref_aa = '*' AND aa_pos = 21 THEN 'stop_site' WHEN aa_pos < 1 OR aa_pos > 20 THEN 'out_of_bounds' WHEN substr('KRDWKRDWKRDWKRDWKRDW', aa_pos::int, 1) = ref_aa THEN 'matched' ELSE 'mismatch' END AS st FROM variants) SELECT count(*) AS total, count(*) FILTER (st = 'matched') AS matched, count(*) FILTER (st = 'mismatch') AS mismatched, count(*) FILTER (st = 'out_of_bounds') AS out_of_bounds, count(*) FILTER (st = 'missing') AS missing, count(*) FILTER (st = 'stop_site') AS stop_site, round(count(*) FILTER (st = 'matched') / (count(*) - count(*) FILTER (st = 'stop_site')), 6) AS rate FROM s")
def residue_summary(spark, sf_dir):
    v = bound(spark, sf_dir, "variants")
    sequences = v.select("gene").distinct().where("gene <> 'G1'").withColumn("seq", F.lit("KRDW" * 5))
    return aggregates.status_summary(annotate.sequence_lookup(v, sequences)).withColumn("rate", F.round("rate", 6))


@query(f"{with_tables('penetrance')} SELECT gene, outcome, CASE WHEN outcome IN ('ASIA', 'EUROPE') THEN '~' || (length(outcome) + 0.5)::decimal(4, 1) || '% general pop.' ELSE 'Baseline unavailable' END AS baseline_text FROM penetrance")
def baseline_lookup(spark, sf_dir):
    p = bound(spark, sf_dir, "penetrance")
    base = p.where("outcome in ('ASIA', 'EUROPE')").select("outcome", (F.length("outcome") + 0.5).alias("rate")).distinct()
    return annotate.baseline_lookup(p.select("gene", "outcome"), base).select("gene", "outcome", "baseline_text")


@query(f"{with_tables('kept', 'penetrance')}, r AS (SELECT gene, outcome, risk_high_pct AS rate FROM penetrance WHERE gene <> 'G4' UNION ALL SELECT 'GEN_DEFAULT', 'any', 5.0 UNION ALL SELECT 'GEN_DEFAULT', 'other', 2.0) SELECT ord, outcome, round(splice * rate, 6)::double AS expected, row_number() OVER (PARTITION BY ord ORDER BY splice * rate DESC, outcome) AS place FROM kept k JOIN r ON CASE WHEN k.gene = 'G4' THEN 'GEN_DEFAULT' ELSE k.gene END = r.gene")
def legacy_risk_fan_out(spark, sf_dir):
    p = bound(spark, sf_dir, "penetrance").where("gene <> 'G4'").select("gene", "outcome", F.col("risk_high_pct").alias("rate"))
    risks = p.unionByName(spark.createDataFrame([("GEN_DEFAULT", "any", 5.0), ("GEN_DEFAULT", "other", 2.0)], "gene string, outcome string, rate double"))
    k = bound(spark, sf_dir, "kept").select("ord", "gene", F.col("splice").cast("double").alias("splice"))
    return annotate.risk_fan_out(k, risks, "splice", ["ord"]).select("ord", "outcome", F.round("expected", 6).alias("expected"), F.col("place").cast("bigint").alias("place"))


_CODONS = "(VALUES " + ", ".join(str(c) for c in quality.codon_changes()) + ") x(ra, i, r, a, aa)"


@query(f"""{with_tables('variants')}, n AS (SELECT *, ord % 1 AS z, regexp_extract(hgvs_name, ':c[.](\\d+)[ACGT]>[ACGT]', 1) AS cp, regexp_extract(hgvs_name, ':c[.]\\d+([ACGT])>', 1) AS cr, regexp_extract(hgvs_name, ':c[.]\\d+[ACGT]>([ACGT])', 1) AS ca FROM variants),
m AS (SELECT *, cp <> '' AND hgvs_name NOT LIKE '%ZZ9%' AND cr = ref AND ca = alt AS plus, cp <> '' AND hgvs_name NOT LIKE '%ZZ9%' AND cr = translate(ref, 'ACGT', 'TGCA') AND ca = translate(alt, 'ACGT', 'TGCA') AS minus, cp <> '' AND hgvs_name NOT LIKE '%ZZ9%' AS own, CASE WHEN cp = '' THEN 1 ELSE cp::int END AS c, variant_class IN ('missense', 'synonymous', 'nonsense', 'start_lost') AS prot FROM n)
SELECT 'label_text' AS \"check\", count(*) FILTER (label IN (0, 1) AND label <> CASE clinical_significance WHEN 'Pathogenic' THEN 1 WHEN 'Likely benign' THEN 0 ELSE 2 END) AS against FROM m
UNION ALL SELECT 'alleles', count(*) FILTER (own AND NOT plus AND NOT minus) FROM m UNION ALL SELECT 'missense_stop', count(*) FILTER (variant_class = 'missense' AND ref_aa = '*') FROM m UNION ALL SELECT 'foreign_gene', count(*) FILTER (hgvs_name LIKE '%ZZ9%') FROM m
UNION ALL SELECT 'genomic_name', count(*) FILTER (hgvs_name LIKE 'NC%' AND regexp_extract(hgvs_name, 'g[.](\\d+)', 1) <> pos::varchar) FROM m UNION ALL SELECT 'residue_place', count(*) FILTER (prot AND (plus OR minus) AND (c - 1) // 3 + 1 <> aa_pos) FROM m
UNION ALL SELECT 'strands', count(*) FROM (SELECT gene FROM m GROUP BY 1 HAVING bool_or(plus) AND bool_or(minus)) UNION ALL SELECT 'reachable', count(*) FROM m WHERE prot AND (plus OR minus) AND NOT EXISTS (SELECT 1 FROM {_CODONS} WHERE ra = ref_aa AND i = (c - 1) % 3 AND r = cr AND x.a = ca AND aa = alt_aa)""")
def name_checks(spark, sf_dir):
    return quality.name_checks(bound(spark, sf_dir, "variants"))


@query(f"""{with_tables('variants')}, e AS (SELECT gene, min(chrom) AS chrom, min(pos) AS s, min(pos) + 1000 AS e FROM variants GROUP BY 1), c AS (SELECT label, count(*) AS n FROM variants GROUP BY 1)
SELECT 'far_from_gene' AS \"check\", count(*) FILTER (v.chrom <> e.chrom OR greatest(s - pos, pos - e.e, 0) > 5000) AS against FROM variants v JOIN e ON v.gene = e.gene
UNION ALL SELECT 'counts_match', count(*) FILTER (label = 2) FROM c UNION ALL SELECT 'distinct_gene', (count(DISTINCT gene) <> 25)::bigint FROM variants UNION ALL SELECT 'distinct_label', (count(DISTINCT label) <> 99)::bigint FROM variants
UNION ALL SELECT 'strand', count(*) FILTER (gene = 'G5') FROM e UNION ALL SELECT 'length', count(*) FILTER (gene = 'G6') FROM e UNION ALL SELECT 'residue_per_codon', count(*) FROM (SELECT gene FROM variants GROUP BY gene, aa_pos HAVING count(DISTINCT ref_aa) > 1) UNION ALL SELECT 'chromosome', count(*) FROM (SELECT gene FROM variants GROUP BY gene HAVING count(DISTINCT chrom) > 1)
UNION ALL SELECT 'in_several_outputs', count(*) FROM (SELECT chrom, pos, ref, alt FROM variants GROUP BY ALL HAVING count(DISTINCT label) > 1)""")
def table_checks(spark, sf_dir):
    v = bound(spark, sf_dir, "variants")
    extents = v.groupBy("gene").agg(F.min("chrom").alias("chrom"), F.min("pos").alias("start"), (F.min("pos") + 1000).alias("end"))
    manifest = v.groupBy("label").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("label") == 2, F.col("n") + 1).otherwise(F.col("n")))
    genes = extents.select("gene", F.when(F.col("gene") == "G5", "?").otherwise("+").alias("strand"), F.when(F.col("gene") == "G6", 5).otherwise(500).alias("length"))
    outputs = [v.where(F.col("label") == x) for x in (0, 1, 2)]
    return quality.suite([
        quality.far_from_gene(v, extents, 5000), quality.counts_match(v, manifest), quality.cardinalities(v, {"gene": 25, "label": 99}), quality.bounds(genes),
        quality.several_values(v, ["gene", "aa_pos"], "ref_aa", "residue_per_codon"), quality.several_values(v, ["gene"], "chrom", "chromosome"), quality.in_several(outputs, annotate.KEY),
    ])


_PRIOR = "coalesce((SELECT r FROM (SELECT class AS c, avg(label) AS r FROM predictions {where} GROUP BY 1) WHERE c = p.class), (SELECT avg(label) FROM predictions {where}))"
_AUC_OF = "SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc, count(*) AS n FROM (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM {table})"


def _prior(train, test):
    return metrics.priors(train, test, ["class"]).withColumn("score", F.round("prior", 9)).drop("prior")


def _auc(scored):
    return metrics.ranking(scored).select(F.round("auc", 6).alias("auc"), (F.col("positives") + F.col("negatives")).alias("n"))


@query(f"{with_tables('predictions')}, t AS (" + " UNION ALL ".join(f"SELECT p.label, round({_PRIOR.format(where=f'WHERE key % 5 <> {k}')}, 9) AS s FROM predictions p WHERE key % 5 = {k}" for k in range(5)) + f") {_AUC_OF.format(table='t')}")
def out_of_fold(spark, sf_dir):
    p = bound(spark, sf_dir, "predictions").withColumn("fold", (F.col("key") % 5).cast("int"))
    return _auc(evaluation.out_of_fold(p, _prior))


@query(f"{with_tables('predictions')}, g AS (SELECT grp, dense_rank() OVER (ORDER BY grp) % 2 AS side FROM (SELECT DISTINCT grp FROM predictions)), q AS (SELECT p.*, side FROM predictions p JOIN g ON p.grp = g.grp), m AS (SELECT class, avg(label) AS r FROM q WHERE side = 1 GROUP BY 1), t AS (SELECT label, round(coalesce(r, (SELECT avg(label) FROM q WHERE side = 1)), 9) AS s FROM q LEFT JOIN m ON q.class = m.class WHERE side = 0) {_AUC_OF.format(table='t')}")
def group_transfer(spark, sf_dir):
    p = bound(spark, sf_dir, "predictions")
    groups = sorted(r["grp"] for r in p.select("grp").distinct().collect())  # a handful of sources
    train, test = splits.group_transfer(p, "grp", groups[::2], groups[1::2])
    return _auc(_prior(train, test))


@query(f"{with_tables('predictions')}, m AS (SELECT key // 8 AS b, avg(label) AS r FROM predictions WHERE key % 4 <> 0 GROUP BY 1), t AS (SELECT label, round(r, 9) AS s FROM predictions p JOIN m ON p.key // 8 = m.b WHERE key % 4 = 0) {_AUC_OF.format(table='t')}")
def neighbour_mean_auc(spark, sf_dir):
    p = bound(spark, sf_dir, "predictions").withColumn("b", F.floor(F.col("key") / 8))
    leaked = splits.neighbour_mean(p.where("key % 4 <> 0"), p.where("key % 4 = 0"), ["b"])
    return _auc(leaked.withColumn("score", F.round("neighbour_mean", 9)))


@query()
def ablation_matrix(spark, sf_dir):
    """Two splits by two baselines with intervals, and whether the baselines' intervals meet."""
    p = written(bound(spark, sf_dir, "predictions"), "predictions")
    given = lambda train, test: test
    cuts = {"by_key": (p.where("key % 3 <> 0"), p.where("key % 3 = 0")), "by_block": (p.where("key % 30 >= 10"), p.where("key % 30 < 10"))}
    table = evaluation.ablation(cuts, {"prior": _prior, "score": given})
    meets = evaluation.overlapping(table).select("split", "overlap")
    return table.join(meets, "split")


@query(f"{with_tables('variants')}, d AS (SELECT gene, CASE WHEN min(dp) % 3 = 0 THEN '+' WHEN min(dp) % 3 = 1 THEN '-' ELSE 'ambiguous' END AS strand FROM (SELECT gene, aa_pos + ord % 7 AS dp FROM variants) GROUP BY 1 HAVING gene <> 'G2'), e AS (SELECT count(DISTINCT gene) AS n FROM variants) SELECT max(n) AS groups, count(*) FILTER (strand = '+') AS plus, count(*) FILTER (strand = '-') AS minus, max(n) - count(*) FILTER (strand IN ('+', '-')) AS other, count(*) FILTER (strand = '+') AS agreeing, round(100.0 * count(*) FILTER (strand = '+') / max(n), 6) AS agreement_pct FROM d, e")
def panel_rollup(spark, sf_dir):
    v = bound(spark, sf_dir, "variants")
    low = F.min(F.col("aa_pos") + F.col("ord") % 7) % 3
    derived = v.where("gene <> 'G2'").groupBy("gene").agg(F.when(low == 0, "+").when(low == 1, "-").otherwise("ambiguous").alias("strand"))
    known = v.select("gene").distinct().withColumn("strand", F.lit("+"))
    return aggregates.panel_rollup(derived, known, "gene", "strand").withColumn("agreement_pct", F.round("agreement_pct", 6))


@query(f"{with_tables('variants')}, x AS (SELECT gene, CASE WHEN variant_class = 'missense' AND ref_aa = 'W' THEN 'stop_lost' ELSE variant_class END AS k FROM variants), c AS (SELECT gene, k, count(*) AS n FROM x WHERE k IN ('missense', 'nonsense', 'stop_lost') GROUP BY 1, 2) SELECT gene, string_agg(k || '=' || n, ';' ORDER BY k) AS classes FROM c GROUP BY 1")
def class_counts(spark, sf_dir):
    """Protein classes of each gene, missense from a stop counted as stop_lost (W stands for the stop here)."""
    v = bound(spark, sf_dir, "variants").withColumn("ref_aa", F.when((F.col("variant_class") == "missense") & (F.col("ref_aa") == "W"), "*").otherwise(F.col("ref_aa")))
    kept = quality.protein_rows(quality.fix_stop_lost(v), ("missense", "nonsense", "stop_lost"))
    counts = aggregates.class_counts(kept, "gene", "variant_class")
    text = F.concat_ws(";", F.transform(F.map_entries("classes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return counts.select("gene", text.alias("classes"))


@query(f"{with_tables('calls')}, t AS (SELECT ord, gene, CASE WHEN dp % 5 = 0 THEN '' ELSE consequence END AS c FROM calls), n AS (SELECT gene, c, count(*) AS n, min(ord) AS f FROM t WHERE c <> '' GROUP BY 1, 2), p AS (SELECT gene, c AS best FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n DESC, f) AS rn FROM n) WHERE rn = 1) SELECT ord, (c = best)::int AS on_primary FROM t JOIN p ON t.gene = p.gene")
def primary_flag(spark, sf_dir):
    t = bound(spark, sf_dir, "calls").select("ord", "gene", F.when(F.col("dp") % 5 == 0, "").otherwise(F.col("consequence")).alias("c"))
    return aggregates.primary_flag(t, "gene", "c", "ord", "on_primary").select("ord", "on_primary")


@query(f"{with_tables('registry')}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY ord) AS rn FROM registry WHERE ord % 3 <> 0) WHERE rn = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY ord) AS rn FROM registry WHERE ord % 3 <> 1) WHERE rn = 1) SELECT a.significance AS before, b.significance AS after, count(*) AS n FROM a JOIN b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt WHERE a.significance <> b.significance GROUP BY 1, 2")
def changed_classes(spark, sf_dir):
    r = bound(spark, sf_dir, "registry")
    old, new = (aggregates.keep_first(r.where(f"ord % 3 <> {n}"), annotate.KEY, "ord") for n in (0, 1))
    return aggregates.changed_classes(old, new, annotate.KEY, "significance")


@query(f"{with_tables('calls')} SELECT ord, CASE WHEN splice_pct >= 90 THEN 'very_high' WHEN splice_pct >= 65 THEN 'high' WHEN splice_pct >= 35 THEN 'uncertain' WHEN splice_pct >= 10 THEN 'low' ELSE 'very_low' END AS band, CASE WHEN dp % 3 = 0 THEN 'p.K5R' WHEN dp % 3 = 1 THEN 'c.5A>G' ELSE consequence END AS shown, dp::double AS low, (dp + 7)::double AS high FROM calls")
def report_texts(spark, sf_dir):
    p = F.when(F.col("dp") % 3 == 0, "p.K5R").otherwise(".")
    c = F.when(F.col("dp") % 3 == 1, "c.5A>G")
    back = report.parse_range(report.risk_range(F.col("dp").cast("double"), F.col("dp") + 7.0))
    rows = bound(spark, sf_dir, "calls").select("ord", legacy.first_bands(F.col("splice_pct") / 100).alias("band"), report.display_annotation(p, c, F.col("consequence")).alias("shown"), back.alias("r"))
    return rows.select("ord", "band", "shown", "r.low", "r.high")


@query(f"{with_tables('variants')} SELECT gene, count(*) AS n FROM variants GROUP BY 1 ORDER BY n DESC, gene LIMIT 8")
def largest_groups(spark, sf_dir):
    return aggregates.largest_groups(bound(spark, sf_dir, "variants"), "gene")


@query(f"{with_tables('variants')} SELECT ord, gene, aa_pos FROM variants WHERE gene <> 'G1' AND NOT (ref_aa = '*' AND aa_pos = 21) AND aa_pos BETWEEN 1 AND 20 AND substr('KRDWKRDWKRDWKRDWKRDW', aa_pos::int, 1) <> ref_aa ORDER BY ord LIMIT 10")
def first_mismatches(spark, sf_dir):
    v = bound(spark, sf_dir, "variants")
    sequences = v.select("gene").distinct().where("gene <> 'G1'").withColumn("seq", F.lit("KRDW" * 5))
    return aggregates.first_mismatches(annotate.sequence_lookup(v, sequences), ["ord"]).select("ord", "gene", "aa_pos")


@query(f"{with_tables('variants')} SELECT variant_class, count(*) AS n, count(*) FILTER (label = 1) AS positives, CASE variant_class WHEN 'synonymous' THEN 0 WHEN 'missense' THEN 1 WHEN 'nonsense' THEN 2 WHEN 'start_lost' THEN 3 WHEN 'stop_lost' THEN 4 WHEN 'intronic' THEN 7 ELSE 10 END AS class_id FROM variants GROUP BY 1")
def classes_in_order(spark, sf_dir):
    counts = aggregates.class_distribution(bound(spark, sf_dir, "variants"), "variant_class", "label").drop("pct")
    return aggregates.in_vocabulary_order(counts)


@query(f"{with_tables('variants')}, l AS (SELECT gene, aa_pos AS c, pos, CASE WHEN cast(substr(gene, 2) AS int) % 2 = 1 THEN -1 ELSE 1 END AS s, lag(aa_pos) OVER w AS c0, lag(pos) OVER w AS p0 FROM variants WINDOW w AS (PARTITION BY gene ORDER BY aa_pos, pos)) SELECT gene, count(*) FILTER (c > c0 AND s * (pos - p0) < 0) AS breaks FROM l GROUP BY 1")
def coordinate_breaks(spark, sf_dir):
    v = bound(spark, sf_dir, "variants").withColumn("strand", F.when(F.substring("gene", 2, 9).cast("int") % 2 == 1, "-").otherwise("+"))
    return aggregates.coordinate_breaks(v, ["gene"], "strand", "aa_pos")
