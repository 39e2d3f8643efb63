"""Registered queries of cases that ordinary rows don't reach: texts in odd forms, missing parts, repeated and mixed rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from locusframe.functions import features, hgvs, vcf
from locusframe.operators import aggregates, annotate, classify, evaluation, extraction, featurised, metrics, models, ranks, splits
from locusframe.plans.bindings import bound, with_tables
from locusframe.plans.queries import query
from locusframe.sources import bgzf, readers
from locusframe.sources.shared import shared_path, written

#: Registry texts with the tier and score that each has to get.
VERDICT_TEXTS = [
    ("Pathogenic", "Pathogenic", 0.999), ("Likely pathogenic", "Likely Pathogenic", 0.95), ("Pathogenic; Likely risk allele", "Pathogenic", 0.999), ("Pathogenic/Likely pathogenic", "Likely Pathogenic", 0.95),
    ("Benign", "Benign", 0.001), ("Likely benign", "Likely Benign", 0.05), ("Benign; likely drug response", "Benign", 0.001), ("Conflicting classifications of pathogenicity", "VUS", 0.5),
    ("Uncertain significance", "VUS", 0.5), ("Pathogenic; Benign", "VUS", 0.5), ("pathogenicity asserted", "VUS", 0.5), ("VUS-high, pathogenic", "VUS", 0.5),
]
_TEXT = "CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _, _) in enumerate(VERDICT_TEXTS)) + " END"


@query(f"SELECT {_TEXT} AS significance, " + ", ".join(f"min(CASE o_orderkey % 12 {' '.join(f'WHEN {i} THEN {v!r}' for i, v in enumerate(x))} END) AS {n}" for n, x in (("tier", [t for _, t, _ in VERDICT_TEXTS]), ("score", [s for _, _, s in VERDICT_TEXTS]))).replace("END) AS score", "END)::double AS score") + ", count(*) AS n FROM orders GROUP BY 1")
def significance_scores(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr(_TEXT).alias("significance")).groupBy("significance").agg(F.count("*").alias("n"))
    return o.withColumn("t", hgvs.significance_tier(F.col("significance"))).select("significance", "t.tier", "t.score", "n")


# a call's splice text in ten forms; x is its delta as text, alt its allele
_FORMS = """CASE ord % 10 WHEN 0 THEN 'SpliceAI=' || alt || '|X|.|' || x || '|.|.' WHEN 1 THEN 'SpliceAI=' || alt || '|X|' || x || '||0.0|0' WHEN 2 THEN 'SpliceAI=' || lower(alt) || '|X|0.00|' || x || '|0.00|0.00|5'
 WHEN 3 THEN 'SpliceAI=-|X|0.9|0.9|0.9|0.9' WHEN 4 THEN 'DB;SpliceAI_max=' || x WHEN 5 THEN 'spliceai_ds_MAX=' || x || ';DB' WHEN 6 THEN 'SpliceAI=' || alt || '|X|0.9|bad|0|0,.|X|' || x || '|0|0|0' WHEN 7 THEN 'SpliceAI=' || alt || '|X|.|.|.|.'
 WHEN 8 THEN 'XDS_MAX=0.9;SpliceAI=' || alt || '|X|0.9|0.9' ELSE 'DS_MAX=' || x || ';SpliceAI=' || alt || '|X|0.99|0|0|0' END"""
_SPLICED = f"{with_tables('calls')}, f AS (SELECT ord, alt, ref, splice_pct, cast(splice_pct / 100.0 AS varchar(9)) AS x FROM calls)"


@query(f"{_SPLICED} SELECT ord, (CASE WHEN ord % 10 IN (0, 1, 2, 4, 5, 6) THEN splice_pct / 100.0 WHEN ord % 10 = 9 THEN 0.99 END)::double AS one, (CASE WHEN ord % 10 IN (0, 1, 2) THEN splice_pct / 100.0 WHEN ord % 10 = 9 THEN 0.99 END)::double AS of_two FROM f")
def splice_forms(spark, sf_dir):
    """Splice scores of one alternative, and of one of two (tags and unnamed entries don't tell which)."""
    rows = bound(spark, sf_dir, "calls").withColumn("x", F.format_string("%.2f", F.col("splice_pct") / 100.0)).withColumn("info", F.expr(_FORMS))
    score = lambda n: vcf.splice_score(F.col("info"), F.col("ref"), F.col("alt"), F.lit(n))
    return rows.select("ord", score(1).alias("one"), score(2).alias("of_two"))


@query(f"{with_tables('calls')} SELECT ord, (CASE WHEN ord % 6 IN (0, 1, 2, 3) THEN af_milli / 1000.0 END)::double AS af FROM calls")
def frequency_forms(spark, sf_dir):
    """Population frequency where keys are empty, missing, repeated or not a number."""
    x = F.format_string("%.3f", F.col("af_milli") / 1000.0)
    forms = [F.concat(F.lit("AF=;gnomAD_AF="), x), F.concat(F.lit("AF_raw="), x, F.lit(";AF=0.7")), F.concat(F.lit("MAF=0.3;AF="), x, F.lit(",0.9")), F.concat(F.lit("AF= "), x), F.lit("AF=."), F.lit("AF=;DB")]
    return bound(spark, sf_dir, "calls").select("ord", vcf.allele_frequency(F.get(F.array(*forms), (F.col("ord") % 6).cast("int")), F.lit(0)).alias("af"))


_BLOCK = "CASE WHEN ord % 3 = 0 THEN NULL WHEN ord % 3 = 1 THEN 'a' || cast(pos % 2 AS varchar(9)) ELSE cast(pos % 3 AS varchar(9)) END"
_PHASED = f"""{with_tables('calls')}, held AS (SELECT *, CASE WHEN gt = '0/1' AND pos % 5 = 0 THEN '1/2' ELSE gt END AS g, {_BLOCK} AS ps FROM calls WHERE gt NOT IN ('0/0', '1/1') AND dp > 44),
stake AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, gene, chrom, pos, ref, alt ORDER BY ord DESC) AS rn FROM held) WHERE rn = 1)"""


@query(f"""{_PHASED}, pairs AS (SELECT a.sample_id, a.gene, CASE WHEN a.chrom = b.chrom AND a.pos = b.pos AND a.alt <> b.alt AND '1/2' IN (a.g, b.g) THEN 2 WHEN a.g LIKE '%|%' AND b.g LIKE '%|%' AND a.ps IS NOT DISTINCT FROM b.ps THEN CASE WHEN a.g <> b.g THEN 2 ELSE 0 END ELSE 1 END AS v
 FROM stake a JOIN stake b ON a.sample_id = b.sample_id AND a.gene = b.gene AND (a.chrom, a.pos, a.ref, a.alt) < (b.chrom, b.pos, b.ref, b.alt))
SELECT g.sample_id, g.gene, coalesce(CASE max(v) WHEN 2 THEN 'trans' WHEN 1 THEN 'unphased' WHEN 0 THEN 'cis' END, 'single') AS state FROM (SELECT DISTINCT sample_id, gene FROM stake) g LEFT JOIN pairs p ON g.sample_id = p.sample_id AND g.gene = p.gene GROUP BY 1, 2""")
def phase_blocks(spark, sf_dir):
    """States of calls whose phase sets are texts, numbers or missing, read from FORMAT columns."""
    c = bound(spark, sf_dir, "calls").where("gt not in ('0/0', '1/1') and dp > 44").withColumn("gt", F.expr("CASE WHEN gt = '0/1' AND pos % 5 = 0 THEN '1/2' ELSE gt END"))
    sample = F.concat_ws(":", "gt", F.coalesce(F.expr(_BLOCK.replace("varchar(9)", "string")), F.lit(".")))
    return classify.phase_states(c.withColumn("ps", vcf.format_field(F.lit("GT:PS"), sample, "PS")), "ord")


_MIXED = "SELECT ord, chrom, pos, CASE WHEN ord % 2 = 0 THEN lower(ref) ELSE ref END AS ref, CASE WHEN ord % 3 = 0 THEN lower(alt) WHEN ord % 17 = 0 THEN 'na' ELSE alt END AS alt, 'CD2' AS symbols, 'GRCh38' AS assembly, 'germline' AS origin, CASE WHEN dp % 3 = 0 THEN 'Pathogenic' WHEN dp % 3 = 1 THEN 'Uncertain significance' ELSE 'Conflicting' END AS significance, 'reviewed by expert panel' AS review, CASE WHEN dp % 3 = 2 THEN 'NM_9.9(CD2):c.5A>G' WHEN dp % 2 = 0 THEN 'NM_1.1(CD2):c.5A>G' ELSE 'NM_2.2(CD2):c.5A>G' END AS name FROM calls"


@query(f"""{with_tables('calls')}, d AS ({_MIXED}), f AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, upper(ref), upper(alt) ORDER BY ord) AS rn FROM d WHERE alt <> 'na'), k AS (SELECT * FROM f WHERE rn = 1),
v AS (SELECT split_part(name, '(', 1) AS tx, count(*) AS n, min(CASE WHEN significance = 'Pathogenic' THEN 0 ELSE 1000000000000000000 END + ord) AS o FROM k WHERE significance <> 'Conflicting' GROUP BY 1)
SELECT (SELECT count(*) FROM k) AS variants, (SELECT sum(pos)::bigint FROM k) AS places, (SELECT tx FROM v ORDER BY n DESC, o LIMIT 1) AS transcript, (SELECT count(*) FROM k WHERE significance = 'Conflicting') AS conflicting""")
def mixed_case_extraction(spark, sf_dir):
    """Alleles in both cases are one variant, and conflicting variants have no vote on the transcript."""
    d = spark.sql(_MIXED.replace("FROM calls", "FROM {calls}"), calls=bound(spark, sf_dir, "calls"))
    found = extraction.extract(d, ["CD2"], "ord")
    genes = extraction.gene_manifest(found, spark.createDataFrame([("CD2",)], "gene string"), "ord")
    return found.agg(F.count("*").alias("variants"), F.sum("pos").alias("places")).join(F.broadcast(genes.select(F.col("primary_transcript").alias("transcript"), "conflicting")))  # one row each


@query(f"{with_tables('kept', 'penetrance')}, c AS (SELECT unnest([1, 2]) AS copy, gene, pos, splice FROM kept), r AS (SELECT copy, c.gene, outcome, splice * risk_high_pct AS e FROM c JOIN penetrance p ON c.gene = p.gene) SELECT gene, outcome, count(*) AS n, round(sum(e), 3)::double AS expected, 1::bigint AS last_place FROM r GROUP BY 1, 2")
def repeated_call_risks(spark, sf_dir):
    """Equal calls each have places of their own (each gene has one outcome here)."""
    p = bound(spark, sf_dir, "penetrance").select("gene", "outcome", F.col("risk_high_pct").alias("rate"))
    k = bound(spark, sf_dir, "kept").select("gene", "ord", F.col("splice").cast("double").alias("splice"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    found = annotate.risk_fan_out(k, p, "splice", ["ord", "copy"], "none")
    return found.groupBy("gene", "outcome").agg(F.count("*").alias("n"), F.round(F.sum("expected"), 3).alias("expected"), F.max("place").cast("bigint").alias("last_place"))


@query(f"{with_tables('calls')}, g AS (SELECT sample_id, consequence AS outcome, count(DISTINCT gene) AS genes FROM calls GROUP BY 1, 2) SELECT genes, count(*) AS outcomes FROM g GROUP BY 1")
def outcome_multiplicity(spark, sf_dir):
    """How many (sample, outcome) have one gene behind them, two, and so on."""
    return aggregates.multiplicity(bound(spark, sf_dir, "calls"), ["sample_id", "consequence"], "gene").select(F.col("n").alias("genes"), F.col("groups").alias("outcomes"))


@query(f"{with_tables('sites')} SELECT chrom, filter, count(*) AS n, sum(pos)::bigint AS places, sum(dp)::bigint AS depth, min(af_milli / 1000.0)::double AS least_af FROM sites GROUP BY 1, 2")
def block_gzipped_calls(spark, sf_dir):
    """All calls written as block-gzipped VCF files and read back in byte ranges."""
    s = bound(spark, sf_dir, "sites")
    field = lambda c: F.col(c).cast("string")
    text = F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), field("pos"), F.lit("."), "ref", "alt", F.lit("."), "filter", "info", F.lit("GT:DP:GQ"), F.concat_ws(":", "gt", field("dp"), field("gq")))
    folder = shared_path(spark, "vcf")
    bgzf.write_lines(s.select("line", text.alias("value")), "value", folder, ["line"])
    rows = readers.read_vcf(spark, [r.path for r in bgzf.ranges([folder], 1 << 62)], range_bytes=200_000)
    dp = vcf.format_number(F.col("format"), F.col("sample"), "DP")
    af = vcf.allele_frequency(F.col("info"), F.lit(0))
    return rows.groupBy("chrom", "filter").agg(F.count("*").alias("n"), F.sum("pos").alias("places"), F.sum(dp).alias("depth"), F.min(af).alias("least_af"))


@query(f"{with_tables('calls')}, s AS (SELECT ord, gene, 'S' || cast(dp % 9 AS varchar(9)) AS syn FROM calls) SELECT ord, dense_rank() OVER (ORDER BY gene) - 1 AS gene_id, dense_rank() OVER (ORDER BY syn) - 1 AS syndrome_id, CASE WHEN gene IN (SELECT gene FROM s WHERE ord % 2 = 0 AND gene > 'G2') THEN (SELECT count(DISTINCT gene) FROM s t WHERE t.ord % 2 = 0 AND t.gene > 'G2' AND t.gene < s.gene) ELSE -1 END AS served_id FROM s")
def feature_ids(spark, sf_dir):
    """Numbers of genes and syndromes, and of genes by a dictionary that lacks some of them."""
    rows = bound(spark, sf_dir, "calls").select("ord", "gene", F.concat(F.lit("S"), (F.col("dp") % 9).cast("string")).alias("syndrome_group"))
    part = ranks.dictionary(rows.where("ord % 2 = 0 and gene > 'G2'"), "gene", "served_id")
    return aggregates.ordinal(featurised.with_ids(rows), "gene", "served_id", part, "keep").select("ord", "gene_id", "syndrome_id", "served_id")


@query(f"{with_tables('calls', 'registry')}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY ord DESC) AS rn FROM registry) WHERE rn = 1) SELECT c.ord, stars, significance FROM calls c LEFT JOIN l ON c.chrom = l.chrom AND c.pos = l.pos AND c.ref = l.ref AND c.alt = l.alt")
def laid_out_registry(spark, sf_dir):
    """Lookups in a registry written once in buckets of its key."""
    known = annotate.lay_out_registry(bound(spark, sf_dir, "registry").withColumnRenamed("ord", "r_ord"), f"registry_{uuid.uuid4().hex}", "r_ord", 8)
    return annotate.registry_lookup(bound(spark, sf_dir, "calls"), known, "r_ord").select("ord", "stars", "significance")


@query(f"{with_tables('calls')}, p AS (SELECT row_number() OVER () AS r, ord, chrom, pos * 50 AS pos FROM calls), i AS (SELECT 'J' || cast(o_orderkey AS varchar(12)) AS gene, cast(o_custkey % 22 + 1 AS varchar(9)) AS chrom, o_orderkey % 4000 * 251 AS a, o_orderkey % 4000 * 251 + power(10, o_orderkey % 5)::bigint * CASE WHEN o_orderkey % 499 = 0 THEN 10000 ELSE 1 END AS b FROM orders WHERE o_orderkey % 9 < 4) SELECT p.ord, count(gene) AS n, CASE WHEN count(gene) = 1 THEN min(gene) END AS gene FROM p LEFT JOIN i ON p.chrom = i.chrom AND p.pos BETWEEN i.a AND i.b GROUP BY r, p.ord")
def interval_sweep(spark, sf_dir):
    """Calls held against intervals of 1 to 1e8 bases."""
    k = F.col("o_orderkey")
    start = k % 4000 * 251
    length = F.pow(F.lit(10), k % 5).cast("bigint") * F.when(k % 499 == 0, 10000).otherwise(1)
    i = spark.read.parquet(f"{sf_dir}/orders.parquet").where(k % 9 < 4).select(F.concat(F.lit("J"), k.cast("string")).alias("gene"), (F.col("o_custkey") % 22 + 1).cast("string").alias("chrom"), start.alias("start"), (start + length).alias("end"))
    return annotate.interval_matches(bound(spark, sf_dir, "calls").select("ord", "chrom", (F.col("pos") * 50).alias("pos")), i, ["ord"])


@query("SELECT vec_id, round(list_sum([x::double * x for x in embedding]), 3)::double AS norm FROM embeddings WHERE embedding IS NOT NULL")
def svd_norms(spark, sf_dir):
    """All components of an embedding keep its length, whatever rows they were fitted on."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    _, vectors = models.svd_components(e.where("vec_id % 3 <> 0"), "embedding", 64)
    made = models.projected(e, "embedding", vectors)
    norm = F.aggregate(F.array(*[F.col(f"component_{i}") for i in range(len(vectors))]), F.lit(0.0), lambda a, x: a + x * x)
    return made.select("vec_id", F.round(norm, 3).alias("norm"))


def _embedded(spark, sf_dir):
    p = bound(spark, sf_dir, "predictions").withColumn("score0", F.col("score").cast("double")).drop("score")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("key"), "embedding")
    return written(p.join(e, "key", "left"), "embedded")


@query()
def gbt_components(spark, sf_dir):
    """Boosted trees with sixteen embedding components fitted on training rows, rounds ended by validation rows."""
    rows = _embedded(spark, sf_dir)
    train, validation, test = (rows.where(w) for w in ("key % 4 > 1", "key % 4 = 1", "key % 4 = 0"))
    return metrics.ranking(models.boosted_with_components(train, test, ["score0"], "embedding", rounds=30, validation=validation))


@query(f"{with_tables('predictions')}, k AS (SELECT unnest(range(5)) AS round) SELECT round::int AS round, count(*) AS rows, 0::bigint AS leaks FROM predictions, k GROUP BY 1 UNION ALL SELECT -1, count(*), 0 FROM predictions")
def nested_fold_sides(spark, sf_dir):
    """Rows of each round and groups on two of its sides; under -1 the rows that are tested once, and others."""
    p = splits.nested_folds(bound(spark, sf_dir, "predictions").withColumn("block", F.floor(F.col("key") / 7)), "block")
    each = p.select("block", F.posexplode("roles").alias("round", "role"))
    sides = each.groupBy("round", "block").agg(F.countDistinct("role").alias("sides"), F.count("*").alias("n"))
    once = p.select((F.size(F.filter("roles", lambda r: r == "test")) == 1).alias("once"))
    return sides.groupBy("round").agg(F.sum("n").alias("rows"), F.count_if(F.col("sides") > 1).alias("leaks")).unionByName(once.agg(F.lit(-1).alias("round"), F.count_if("once").alias("rows"), F.count_if(~F.col("once")).alias("leaks")))


@query(f"{with_tables('predictions')}, m AS (SELECT unnest(['prior', 'scaled']) AS model) SELECT model, count(*) AS rows, count(DISTINCT key) AS keys FROM predictions, m GROUP BY 1")
def nested_out_of_fold(spark, sf_dir):
    """Every row scored once by each model, in the round that tests its group."""
    p = bound(spark, sf_dir, "predictions").withColumn("size", F.col("score").cast("double")).drop("score")
    prior = lambda train, validation, test: metrics.priors(train, test, ["class"]).withColumn("score", F.col("prior")).drop("prior")
    scaled = lambda train, validation, test: test.withColumn("score", F.col("size"))
    found = evaluation.nested_out_of_fold(p, {"prior": prior, "scaled": scaled}, "grp", ["size"])
    return found.where("score is not null").groupBy("model").agg(F.count("*").alias("rows"), F.countDistinct("key").alias("keys"))


#: Consequence terms of annotation files with the class that each has to get.
_TERMS = [
    ("missense_variant", "missense"), ("synonymous_variant", "synonymous"), ("stop_gained", "nonsense"), ("splice_donor_variant", "splice_canonical"), ("splice_acceptor_variant&intron_variant", "splice_canonical"),
    ("splice_region_variant&intron_variant", "splice_region"), ("intron_variant", "intronic"), ("5_prime_UTR_variant", "utr5"), ("3_prime_UTR_variant", "utr3"), ("start_lost", "start_lost"), ("stop_lost", "stop_lost"),
    ("upstream_gene_variant", "other_noncoding"), ("Missense_Variant", "missense"),
]
_TERM = "CASE ord % 13 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _) in enumerate(_TERMS)) + " END"


@query(f"{with_tables('calls')} SELECT {_TERM} AS term, min(CASE ord % 13 {' '.join(f'WHEN {i} THEN {k!r}' for i, (_, k) in enumerate(_TERMS))} END) AS kind, count(*) AS n FROM calls GROUP BY 1")
def consequence_classes(spark, sf_dir):
    terms = bound(spark, sf_dir, "calls").select(F.expr(_TERM).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.select("term", vcf.consequence_class(F.col("term")).alias("kind"), "n")


@query(f"{with_tables('calls')}, s AS (SELECT ord, alt, splice_pct / 50.0 - 1 AS logit FROM calls) SELECT ord, CASE alt WHEN 'A' THEN 0.85 WHEN 'T' THEN 0.65 WHEN 'G' THEN 0.45 ELSE 0.35 END::double AS motif, round(1 / (1 + exp(-(0.8 * logit + 0.1))), 9)::double AS p, CASE WHEN 0.8 * logit + 0.1 >= ln(9) THEN 'Pathogenic' WHEN 0.8 * logit + 0.1 >= ln(7 / 3.0) THEN 'Likely Pathogenic' WHEN 0.8 * logit + 0.1 >= ln(3 / 7.0) THEN 'VUS' WHEN 0.8 * logit + 0.1 >= -ln(9) THEN 'Likely Benign' ELSE 'Benign' END AS tier FROM s")
def calibrated_scores(spark, sf_dir):
    """Motif scores, and calibrated probabilities of logits with their tiers."""
    logit = (F.col("splice_pct") / 50.0 - 1).cast("double")
    p = features.logistic(logit, 0.8, 0.1)
    return bound(spark, sf_dir, "calls").select("ord", features.motif_score(F.col("alt")).cast("double").alias("motif"), F.round(p, 9).alias("p"), features.score_tier(p).alias("tier"))


_CHARGES = "c(aa, q) AS (VALUES ('K', 1.0), ('R', 1.0), ('D', -1.0), ('E', -1.0))"


@query(f"{with_tables('variants')}, {_CHARGES}, x AS (SELECT ord, ref_aa, alt_aa FROM variants WHERE ref_aa IN ('K', 'R', 'D', 'W') AND alt_aa IN ('K', 'R', 'D', 'W')) SELECT ord, (ref_aa = alt_aa) AS same, (coalesce(b.q, 0) - coalesce(a.q, 0))::double AS delta_charge, CASE WHEN ref_aa || alt_aa IN ('KR', 'RK') THEN 26.0 END::double AS published FROM x LEFT JOIN c a ON ref_aa = a.aa LEFT JOIN c b ON alt_aa = b.aa")
def residue_pairs(spark, sf_dir):
    """Charge changes of residue pairs, and the distance of the pair K and R, which is 26 as a whole number."""
    v = bound(spark, sf_dir, "variants").where("ref_aa in ('K', 'R', 'D', 'W') and alt_aa in ('K', 'R', 'D', 'W')")
    found = v.join(F.broadcast(features.pair_table(spark)), ["ref_aa", "alt_aa"])  # 400 rows
    told = F.concat("ref_aa", "alt_aa").isin("KR", "RK")
    return found.select("ord", (F.col("distance") == 0).alias("same"), "delta_charge", F.when(told, F.round("distance")).alias("published"))
