"""The VCF job, reports, readers and writers on hand-made files and rows."""

import json

import pytest
from pyspark.sql import functions as F

from locusframe.functions import features, vcf
from locusframe.operators import aggregates, annotate, classify, evaluation, featurised, metrics, models, quality, ranks, report, splits, vcf_job
from locusframe.sources import readers, sinks
from locusframe.streaming import calls as streaming

HEAD = "##fileformat=VCFv4.2\n##reference=GRCh38\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"


def csq(allele, consequence, symbol, residues="", position="", hgvs_c="", hgvs_p="", transcript=""):
    fields = [""] * 16
    fields[0], fields[1], fields[3], fields[6], fields[10], fields[11], fields[14], fields[15] = allele, consequence, symbol, transcript, hgvs_c, hgvs_p, position, residues
    return "|".join(fields)


LINES = [
    f"chr1\t100\t.\tA\tG\t.\tPASS\tAF=0.0001;CSQ={csq('G', 'stop_gained', 'NONE')},{csq('G', 'frameshift_variant', 'mutyh', hgvs_p='p.K5fs', transcript='T1')}\tGT:DP:GQ:PS\t0|1:50:99:7",
    "chr1\t200\t.\tA\tC\t50\tPASS\tANN=C|splice_donor_variant|HIGH|MUTYH|g|t|T2|b|1|c.6A>C|\tGT:DP:GQ:PS\t1|0:50:99:7",
    "chr2\t300\t.\tC\tT\t50\tPASS\tAF=0.2\tGT:DP:GQ\t0/1:30:60",  # registry, but common
    "chr2\t301\t.\tC\tT\t50\tPASS\t.\tGT:DP:GQ\t1/1:30:60",  # registry, pathogenic
    "chr3\t5000\t.\tG\tA\t50\tPASS\tDS_MAX=0.61\tGT:DP:GQ\t0/1:30:60",  # one interval
    "chr3\t9000\t.\tG\tA\t50\tPASS\t.\tGT:DP:GQ\t0/1:30:60",  # two intervals: no gene
    "chr4\t10\t.\tA\tG,T\t50\tPASS\tAF=0.5,0.0001;CSQ=" + csq("T", "missense_variant", "BRCA1", "K/R", "5") + "\tGT:DP:GQ\t1/2:30:60",  # one alternative is annotated
    "chr4\t20\t.\tA\tG\t50\tLowQual\t.\tGT:DP:GQ\t0/1:30:60",
    "chr4\t30\t.\tA\tG\t50\tPASS\t.\tGT:DP:GQ\t0/1:9:60",
    "chr4\t40\t.\tA\tG\t50\tPASS\t.\tGT:DP:GQ\t0/0:30:60",
    "short\tline",
    "chr9\tx\t.\tA\tG\t50\tPASS\t.\tGT\t0/1",
]


@pytest.fixture
def held(spark):
    registry = spark.createDataFrame(
        [("2", 300, "C", "T", "BRCA1", "missense", "Pathogenic", 3, 1), ("2", 301, "C", "T", "BRCA1", "missense", "Benign", 3, 2), ("2", 301, "C", "T", "BRCA1", "missense", "Pathogenic/Likely pathogenic", 2, 3)],
        "chrom string, pos long, ref string, alt string, gene string, variant_class string, significance string, stars int, ord long",
    )
    intervals = spark.createDataFrame([("ATM", "3", 4000, 9500), ("TP53", "3", 8000, 9100)], "gene string, chrom string, start long, end long")
    risks = spark.createDataFrame([("MUTYH", "Colorectal", 40.0, 62.5, 70, "a", "x"), ("BRCA1", "Breast", 65.0, 72.0, 80, "b", "x"), ("BRCA1", "Bone marrow failure", 1.0, 2.0, 80, "b", "x")], readers.PENETRANCE)
    return vcf_job.Reference(registry, intervals, risks, ["MUTYH", "BRCA1", "ATM", "TP53"], ["MUTYH"])


@pytest.fixture
def verdicts(spark, held, tmp_path):
    (tmp_path / "s.vcf").write_text(HEAD + "\n".join(LINES) + "\n")
    return vcf_job.interpret(spark, str(tmp_path / "s.vcf"), held)


def test_interpret(verdicts):
    got = {(r.chrom, r.pos, r.alt): (r.gene, r.gene_source, r.tier, r.source, r.state) for r in verdicts.collect()}
    assert got == {
        ("1", 100, "G"): ("MUTYH", "csq", "Likely Pathogenic", "loss_of_function", "trans"),
        ("1", 200, "C"): ("MUTYH", "ann", "Likely Pathogenic", "loss_of_function", "trans"),
        ("2", 300, "T"): ("BRCA1", "registry", "Benign", "frequency", None),
        ("2", 301, "T"): ("BRCA1", "registry", "Likely Pathogenic", "registry", None),
        ("3", 5000, "A"): ("ATM", "interval", "Likely Pathogenic", "splice", None),
        ("4", 10, "T"): ("BRCA1", "csq", "Unscored", "unresolved", None),
    }
    one = next(r for r in verdicts.collect() if r.chrom == "4")
    assert (one.ref_aa, one.alt_aa, one.aa_pos, one.is_biallelic, one.af) == ("K", "R", 5, False, 0.0001)
    first = next(r for r in verdicts.collect() if r.pos == 100)
    assert (first.transcript, first.hgvs_p, first.notes, [r.outcome for r in first.cancer_risks]) == ("T1", "p.K5fs", "frameshift_variant; " + classify.STATE_NOTES["trans"], ["Colorectal"])


def test_model_scores_what_is_left(spark, held, tmp_path):
    (tmp_path / "s.vcf").write_text(HEAD + "\n".join(LINES) + "\n")
    scored = vcf_job.interpret(spark, str(tmp_path / "s.vcf"), held, lambda rows: rows.withColumn("model_score", F.lit(0.95)))
    rows = {(r.chrom, r.pos): (r.tier, r.source, r.model_score) for r in scored.collect()}
    assert rows["4", 10] == ("Pathogenic", "model", 0.95) and rows["2", 300][1] == "frequency"


def test_reports(verdicts, tmp_path, spark):
    lines = [r.line for r in report.report_lines(verdicts, "line").orderBy("section", "number").collect()]
    assert lines[:2] == ["TOTAL PANEL VARIANTS EVALUATED: 6", "ACTIONABLE (PATHOGENIC / LIKELY PATHOGENIC): 4"]
    assert [x.split(" | ")[0].strip() for x in lines[2:4]] == ["Breast", "Colorectal"] and "40% - 62%" in lines[3]
    assert lines[4].startswith("VARIANT #1: MUTYH chr1:100 A>G  p.K5fs  Genotype: 0|1 (DP=50, GQ=99)  VERDICT TIER: [LIKELY PATHOGENIC]")
    assert lines[5:8] == ["Evidence: loss_of_function", "Calibrated score: 0.9500", "Notes: frameshift_variant; " + classify.STATE_NOTES["trans"]] and lines[8] == "Colorectal: 40% - 62% (up to age 70) [Source: a, Evidence: x]"
    at = lines.index("Other features, not cancer:")
    assert lines[at + 1] == "Bone marrow failure: 1% - 2% (up to age 80) [Source: b]" and lines[at - 1].startswith("Breast: 65% - 72%")
    assert lines[-1] == report.DISCLAIMER and any("No curated" in x for x in lines)
    told = json.loads(report.report_json(verdicts, "line").first()["value"])
    assert (told["total_variants"], told["actionable_count"]) == (6, 4) and [x["genes"] for x in told["cancer_risk_summary"]] == [["BRCA1"], ["MUTYH"]]
    assert [v["pos"] for v in told["verdicts"]] == [100, 200, 300, 301, 5000, 10] and told["disclaimer"]
    sinks.write_report_lines(report.report_lines(verdicts, "line"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == len(lines)


def test_display_limit(spark):
    rows = [("a", i, "Benign" if i % 5 else "VUS") for i in range(25)] + [("b", i, "Benign") for i in range(20)]
    shown = report.display_rows(spark.createDataFrame(rows, "sample_id string, line long, tier string"), "line")
    a = sorted([r for r in shown.collect() if r.sample_id == "a"], key=lambda r: r.place)
    assert [r.line for r in a] == [0, 5, 10, 15, 20, 1, 2, 3, 4, 6, 7, 8, 9, 11, 12] and {r.omitted for r in a} == {10}
    assert shown.where("sample_id = 'b'").count() == 20


def test_ranges_and_annotation(spark):
    df = spark.createDataFrame([(12.5, 13.5)], "a double, b double")
    assert df.select(report.risk_range(F.col("a"), F.col("b"))).first()[0] == "12% - 14%"
    assert tuple(df.select(report.parse_range(F.lit("65% - 72%")).alias("r")).select("r.*").first()) == (65.0, 72.0)
    rows = spark.createDataFrame([(".", "", "intron"), ("", "c.5A>G", "x"), (None, None, None)], "p string, c string, k string")
    assert [r[0] for r in rows.select(report.display_annotation(F.col("p"), F.col("c"), F.col("k"))).collect()] == ["intron", "c.5A>G", "—"]


def test_quarantine_and_registry_rows(spark, tmp_path):
    (tmp_path / "s.vcf").write_text(HEAD + "\n".join(LINES) + "\n")
    assert sorted(r.reason for r in readers.quarantined_lines(spark, str(tmp_path / "s.vcf")).collect()) == ["position", "short"]
    names = ["#" + readers.REGISTRY_COLUMNS[0], *readers.REGISTRY_COLUMNS[1:]]
    full = ["G", "GRCh38", "germline", "Pathogenic", "x", "snv", "n", "1", "5", "A", ""]
    (tmp_path / "r.tsv").write_text("\t".join(names) + "\n" + "\t".join(full) + "\n" + "\t".join(full[:5]) + "\n")
    rows = readers.read_registry(spark, str(tmp_path / "r.tsv")).collect()
    assert [(r.GeneSymbol, r.AlternateAlleleVCF) for r in rows] == [("G", "")]
    (tmp_path / "bad.tsv").write_text("#A\tB\n1\t2\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_registry(spark, str(tmp_path / "bad.tsv"))


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">BRCA1 strand=- length=1863bp\nMK\nlr\n>sp|P1|X GN=TP53 OS=y\nMM\n")
    rows = {r.gene: (r.seq, r.header) for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows["BRCA1"][0] == "MKLR"
    values = spark.createDataFrame([("strand=- length=1863bp",), ("x",)], "h string").select(*readers.key_values(F.col("h"))).collect()
    assert [tuple(r) for r in values] == [("-", 1863), ("+", 50000)]
    fields = spark.createDataFrame([("sp|P1|X GN=TP53 OS=y",)], "h string").select(*readers.fasta_header_fields(F.col("h"))).first()
    assert tuple(fields) == ("P1", "TP53")
    (tmp_path / "k.json").write_text('{"A": {"chrom": "1", "start": 5}, "B": {"chrom": "2", "start": 6}}')
    assert sorted(tuple(r) for r in readers.read_keyed_json(spark, str(tmp_path / "k.json"), "chrom string, start int").collect()) == [("A", "1", 5), ("B", "2", 6)]


def test_caches_and_sinks(spark, tmp_path):
    scores = spark.createDataFrame([("A", 5, {"K": -0.5, "R": -2.0}, [0.5, 1.0])], "gene string, aa_pos int, scores map<string,double>, embedding array<double>")
    sinks.write_score_cache(scores, str(tmp_path / "cache"))
    cache = readers.read_score_cache(spark, str(tmp_path / "cache"))
    rows = spark.createDataFrame([("A", 5, "K", "R"), ("A", 6, "K", "R"), ("A", 5, "K", "Ter")], "gene string, aa_pos int, ref_aa string, alt_aa string")
    found = annotate.score_lookup(rows, cache, 2).withColumn("m", features.masked_llr(F.col("scores"), F.col("ref_aa"), F.col("alt_aa")))
    assert sorted((r.aa_pos, r.alt_aa, r.has_scores, r.embedding, *r.m) for r in found.collect()) == [(5, "R", 1, [0.5, 1.0], -1.5, 1), (5, "Ter", 1, [0.5, 1.0], 0.0, 0), (6, "R", 0, [0.0, 0.0], 0.0, 0)]
    sinks.write_features(rows, str(tmp_path / "f"), "csv")
    assert spark.read.csv(str(tmp_path / "f"), header=True).count() == 3
    built = []

    def build(missing):
        built.append(missing.count())
        return missing.withColumn("v", F.lit(1))

    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    assert sinks.append_missing(spark, str(tmp_path / "t"), keys.limit(1), ["k"], build).count() == 1
    assert sinks.append_missing(spark, str(tmp_path / "t"), keys, ["k"], build).count() == 2 and built == [1, 1]
    dest = sinks.label_destination(F.col("label"), F.col("indel"))
    labels = spark.createDataFrame([(1, False), (0, True), (2, False), (-1, False)], "label int, indel boolean")
    sinks.write_routed(labels, dest, str(tmp_path / "routed"))
    assert {r.dest: r["count"] for r in spark.read.parquet(str(tmp_path / "routed")).groupBy("dest").count().collect()} == {"labelled": 1, "indel": 1, "vus": 1, "conflict": 1}
    assert sinks.markdown_rows(labels.limit(1), ["label", "indel"]).first()[0] == "| 1 | false |"


@pytest.mark.parametrize(("kind", "ref", "alt", "pos", "want"), [
    ("start_lost", "M", "?", 1, (1, 0.0, 215.0, 1.0, -149.21, 0.0)), ("stop_lost", "*", "K", 0, (1, 1.0, 200.0, 1.0, 146.19, 1.0)), ("stop_lost", "*", "?", 30, (1, 1.0, 200.0, 1.0, 0.0, 0.0)),
    ("nonsense", "K", "*", 5, (1, 0.25, 200.0, 1.0, -146.19, -1.0)), ("synonymous", "*", "*", 5, (1, 0.25, 200.0, 1.0, 0.0, 0.0)), ("missense", "K", "D", 5, (1, 0.25, 101.0, 0.3333, -13.09, -2.0)),
    ("missense", "K", "K", 5, (1, 0.25, 0.0, 0.0, 0.0, 0.0)), ("intronic", ".", ".", 0, (0, 0.0, 0.0, 0.0, 0.0, 0.0)), ("missense", "K", "U", 5, (0, 0.0, 0.0, 0.0, 0.0, 0.0)),
])
def test_featurise(spark, kind, ref, alt, pos, want):
    residues = spark.createDataFrame([("K", 146.19, 1.0, 0.0, 0.0), ("D", 133.1, -1.0, 0.0, 0.0), ("M", 149.21, 0.0, 0.0, 0.0)], "aa string, mw double, charge double, logp double, tpsa double")
    pairs = spark.createDataFrame([("K", "D", 101.0, 0.33333), ("K", "K", 0.0, 0.0)], "ref_aa string, alt_aa string, distance double, dissimilarity double")
    genes = spark.createDataFrame([("A", "-", 20)], "gene string, strand string, length int")
    rows = spark.createDataFrame([("A", "A", "G", kind, ref, alt, pos)], "gene string, ref string, alt string, variant_class string, ref_aa string, alt_aa string, aa_pos int")
    r = featurised.featurise(rows, genes, residues, pairs).first()
    assert (r.has_protein_change, r.rel_protein_pos, r.severity, r.dissimilarity, r.delta_mw, r.delta_charge) == want
    assert (r.cs_ref_T, r.cs_alt_C, r.ref_A, r.is_transition) == (1, 1, 1, 1)


def test_fill(spark):
    rows = spark.createDataFrame([(None, float("nan")), (1.0, 2.0)], "a double, b double")
    assert sorted(tuple(r) for r in featurised.filled(rows, ["a", "b"]).collect()) == [(0.0, 0.0), (1.0, 2.0)]


def test_phase_of_one_site_and_blocks(spark):
    schema = "sample_id string, gene string, chrom string, pos long, ref string, alt string, gt string, ps int, ord long"
    rows = [("s", "A", "1", 5, "A", "G", "1/2", None, 1), ("s", "A", "1", 5, "A", "T", "1/2", None, 2), ("s", "B", "1", 5, "A", "G", "0|1", 7, 1), ("s", "B", "1", 6, "A", "G", "0|1", 8, 2), ("s", "C", "1", 5, "A", "G", "0/1", None, 1), ("s", "C", "1", 5, "A", "G", "0/1", None, 2)]
    rows += [("s", "D", "1", p, "A", "G", "0|1", 7, p) for p in (1, 2, 3)] + [("s", "E", "1", 1, "A", "G", "0|1", 7, 1), ("s", "E", "1", 2, "A", "G", "1|0", 7, 2), ("s", "E", "1", 3, "A", "G", "0/1", None, 3)]
    got = {r.gene: r.state for r in classify.phase_states(spark.createDataFrame(rows, schema), "ord").collect()}
    assert got == {"A": "trans", "B": "unphased", "C": "single", "D": "cis", "E": "trans"}


def test_ranks_over_many_ranges(spark):
    rows = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 7919 % 1000 / 100.0).alias("score"), (F.col("id") * 31 % 7 < 3).cast("int").alias("label"))
    one = {r.key: r.n for r in ranks.numbered(rows, ["label"], F.col("score"), ["key"], "n").collect()}
    ranged = ranks.with_range(rows, F.col("score"), 50)
    assert ranged.select("_range").distinct().count() > 15
    many = ranks.running(ranged, ["label"], [F.col("score"), F.col("key")], {"n": F.lit(1)})
    assert {r.key: r.n + 1 for r in many.collect()} == one
    plain = metrics.ranking(rows).first()
    by = metrics.ranking(rows.withColumn("g", F.col("key") % 2), by=["g"]).count()
    assert by == 2 and plain.positives + plain.negatives == 1000


def test_group_folds_many_groups(spark):
    rows = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("g"))
    got = splits.group_folds(rows, "g")
    sizes = sorted(r["count"] for r in got.groupBy("fold").count().collect())
    assert got.count() == 30_000 and got.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert sizes[-1] == 10_000 and sizes[0] > 4_900
    with pytest.raises(ValueError, match="both sides"):
        splits.group_transfer(rows, "g", [1], [1, 2])


def test_models_and_evaluation(spark):
    rows = spark.createDataFrame([([1.0, 0.0],), ([0.0, 2.0],), ([0.0, 0.0],), (None,)], "e array<double>")
    assert [round(r.value, 9) for r in models.truncated_svd(rows, "e", 2).orderBy("component").collect()] == [2.0, 1.0]
    frame = models.score_batches(spark.createDataFrame([(1.0,), (2.0,)], "x double"), lambda f: f["x"] * 2)
    assert sorted(r.logit for r in frame.collect()) == [2.0, 4.0]
    members = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "key int, logit double")
    assert {r.key: r.logit for r in metrics.ensemble(members, "key").collect()} == {1: 2.0, 2: 5.0}
    table = spark.createDataFrame([("s", "a", 0.1, 0.5), ("s", "b", 0.5, 0.9), ("s", "c", 0.6, 0.9)], "split string, model string, auc_low double, auc_high double")
    assert {(r.a, r.b): r.overlap for r in evaluation.overlapping(table).collect()} == {("a", "b"): True, ("a", "c"): False, ("b", "c"): True}


def test_lookups(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    dim = spark.createDataFrame([("a", 5)], "k string, v int")
    assert {r.k: r.v for r in annotate.lookup(rows, dim, ["k"], {"v": 7}).collect()} == {"a": 5, "b": 7}
    with pytest.raises(ValueError, match="unknown k: b"):
        annotate.require_known(rows, dim, "k")
    found = annotate.best_candidate(spark.createDataFrame([("g", 1, False), ("g", 2, True), ("h", 3, False)], "g string, o int, ok boolean"), "g", F.col("ok"), "o")
    assert {(r.g, r.o) for r in found.collect()} == {("g", 2), ("h", 3)}
    risks = spark.createDataFrame([("x",), ("y",)], "outcome string")
    told = annotate.baseline_lookup(risks, spark.createDataFrame([("x", 12.5)], "outcome string, rate double"))
    assert {r.outcome: (r.baseline, r.baseline_text) for r in told.collect()} == {"x": (12.5, "~12.5% general pop."), "y": (None, "Baseline unavailable")}


def test_parity_and_alignment(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.1)], "k int, v double")
    assert [tuple(r) for r in quality.parity(a, b, ["k"], ["v"]).collect()] == [("v", 1)]
    fixed = quality.fix_stop_lost(spark.createDataFrame([("missense", "*"), ("missense", "K")], "variant_class string, ref_aa string"))
    assert sorted(r.variant_class for r in fixed.collect()) == ["missense", "stop_lost"]


def test_text_helpers(spark):
    from locusframe.functions import hgvs

    df = spark.createDataFrame([("Ter", "chr5", "missense_variant"), ("k", "5", "splice_donor_variant"), ("Xyz", "chrX", None)], "a string, c string, k string")
    got = df.select(hgvs.amino_code(F.col("a")), vcf.plain_chromosome(F.col("c")), vcf.consequence_class(F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("*", "5", "missense"), ("K", "5", "splice_canonical"), (None, "X", "other_noncoding")]
    name = spark.createDataFrame([("NM_1.1(A):c.5A>G",), ("x",)], "n string").select(hgvs.substitution(F.col("n")).alias("s")).collect()
    assert [r.s and tuple(r.s) for r in name] == [(5, "A", "G"), None]


def test_stream_of_calls(spark, tmp_path):
    schema = "chrom string, pos long, ref string, alt string, filter string, dp int, gq int, gt string, af double, consequence string, splice double, ref_aa string"
    rows = [("1", 5, "A", "G", "PASS", 50, 90, "0/1", 0.5, "x", 0.0, None), ("1", 6, "A", "G", "PASS", 50, 90, "0/1", 0.0, "frameshift", 0.0, None), ("1", 7, "A", "G", "PASS", 5, 90, "0/1", 0.0, "x", 0.0, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    registry = spark.createDataFrame([("1", 6, "A", "G", "Benign", 1, 1)], "chrom string, pos long, ref string, alt string, significance string, stars int, ord long")
    told = streaming.classified_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), registry, "ord")
    query = told.writeStream.format("memory").queryName("told_calls").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert {(r.pos, r.tier) for r in spark.table("told_calls").collect()} == {(5, "Benign"), (6, "Likely Pathogenic")}


def test_class_counts_and_flags(spark):
    rows = spark.createDataFrame([("A", "x", 1), ("A", "x", 2), ("A", "y", 3), ("A", "", 4), ("B", None, 5)], "gene string, t string, ord long")
    assert {r.gene: r.classes for r in aggregates.class_counts(rows, "gene", "t").collect()} == {"A": {"x": 2, "y": 1, "": 1}}
    assert {r.ord: r.on for r in aggregates.primary_flag(rows, "gene", "t", "ord", "on").collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_manifest_json(spark):
    from locusframe.operators import extraction

    genes = spark.createDataFrame([("A", 40, 5, 1, 0, "T1", False), ("B", 1, 0, 0, 0, None, True), ("C", 0, 0, 2, 0, None, True)], "gene string, pathogenic long, benign long, uncertain long, conflicting long, primary_transcript string, is_sparse boolean")
    classes = spark.createDataFrame([("A", {"missense": 45})], "gene string, classes map<string,long>")
    told = json.loads(extraction.manifest_json(genes, classes, {"min_stars": 1, "indels": False}).first()["value"])
    assert (told["pathogenic"], told["genes_without_labels"], told["sparse_genes"], told["parameters"]) == (41, ["C"], ["B"], {"min_stars": 1, "indels": False})
    assert [g["gene"] for g in told["genes"]] == ["A", "B", "C"] and told["genes"][0]["classes"] == {"missense": 45}
