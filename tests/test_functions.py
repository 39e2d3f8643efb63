"""Readers and expressions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from locusframe.functions import features, hgvs, vcf
from locusframe.operators import classify
from locusframe.sources import readers

NAMES = {
    "NM_007294.4(BRCA1):c.181T>G (p.Cys61Gly)": ("missense", "C", "G", 61), "x (p.Ter214Leu)": ("stop_lost", "*", "L", 214), "x (p.Met1Val)": ("start_lost", "M", "V", 1), "x (p.Met1?)": ("start_lost", "M", "?", 1),
    "x (p.Arg5Ter)": ("nonsense", "R", "*", 5), "x (p.Lys5=)": ("synonymous", "K", "K", 5), "x (p.Ter5=)": ("synonymous", "*", "*", 5), "x (p.Ter5?)": ("stop_lost", "*", "?", 5), "NM_1.1(A):c.10+2T>A": ("splice_canonical", ".", ".", 0),
    "NM_1.1(A):c.10-8T>A": ("splice_region", ".", ".", 0), "NM_1.1(A):c.10+9T>A": ("intronic", ".", ".", 0), "x:c.-5G>A": ("utr5", ".", ".", 0), "x:c.*5G>A": ("utr3", ".", ".", 0), "n.5A>G": ("other_noncoding", ".", ".", 0), "x (p.Gly5fs)": ("frameshift", ".", ".", 0),
}


def test_names(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", hgvs.classify_name(F.col("n")).alias("c")).collect()
    assert {r.n: tuple(r.c) for r in rows} == NAMES


def test_zygosity_and_significance(spark):
    rows = spark.createDataFrame([("0/0",), ("2/2",), ("2|2",), ("./.",), ("0/1",)], "g string").select(vcf.zygosity(F.col("g"))).collect()
    assert [r[0] for r in rows] == ["Hom-Ref", "Hom", "Hom", "No-call", "Het"]
    texts = ["Conflicting classifications of pathogenicity", "Pathogenic; Benign", "Uncertain significance", "Pathogenic"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(hgvs.significance_tier(F.col("t"))["tier"]).collect()
    assert [r[0] for r in rows] == ["VUS", "VUS", "VUS", "Pathogenic"]


def test_window(spark):
    rows = spark.createDataFrame([("M" * 3418, p) for p in (10, 1709, 3410)], "s string, p int").select(*features.centred_window(F.col("s"), F.col("p"))).collect()
    assert [(len(r[0]), r[1]) for r in rows] == [(1022, 9), (1022, 511), (1022, 1013)]


@pytest.mark.parametrize(("a", "b", "ps", "state"), [("0|1", "1|0", 100, "trans"), ("0|1", "0|1", 100, "cis"), ("0/1", "0/1", None, "unphased"), ("0|1", None, None, "single")])
def test_phase(spark, a, b, ps, state):
    rows = [("s", "MUTYH", "1", 10, "A", "G", a, ps, 1)] + ([("s", "MUTYH", "1", 20, "A", "G", b, ps, 2)] if b else [])
    df = spark.createDataFrame(rows, "sample_id string, gene string, chrom string, pos long, ref string, alt string, gt string, ps int, ord long")
    assert [r.state for r in classify.phase_states(df, "ord").collect()] == [state]


def test_vcf_reader_and_assembly(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##reference=GRCh38\n#CHROM\nchr1\t5\t.\tg\tA,T\t.\tPASS\tAF=.,0.0002\tGT:DP:GQ\t1/2:50:99\nshort\tline\n")
    (tmp_path / "b.vcf").write_text("##reference=hg19\n")
    sites = readers.read_vcf(spark, str(tmp_path / "a.vcf"))
    rows = classify.split_alternatives(sites.withColumn("gt", vcf.format_field(F.col("format"), F.col("sample"), "GT"))).withColumn("af", vcf.allele_frequency(F.col("info"), F.col("alt_index"))).orderBy("alt_index").collect()
    assert [(r.chrom, r.pos, r.ref, r.alt, r.qual, r.af, r.is_biallelic) for r in rows] == [("1", 5, "G", "A", 100.0, None, False), ("1", 5, "G", "T", 100.0, 0.0002, False)]
    readers.require_assembly(spark, str(tmp_path / "a.vcf"))
    with pytest.raises(ValueError, match="older"):
        readers.require_assembly(spark, str(tmp_path / "b.vcf"))


@pytest.mark.parametrize(
    ("info", "alts", "ref", "alt", "score"),
    [
        ("SpliceAI=T|X|.|0.88|.|.", 1, "A", "T", 0.88), ("SpliceAI=T|X|0.88||0.1|0", 1, "A", "T", 0.88), ("SpliceAI=t|X|0|0.5|0|0", 2, "A", "T", 0.5), ("SpliceAI=-|X|0.9|0|0|0", 1, "AT", "A", None),
        ("SpliceAI_max=0.91", 1, "A", "T", 0.91), ("SpliceAI_max=0.91", 2, "A", "T", None), ("ds_max=0.3;SpliceAI=T|X|0.2|0|0|0", 1, "A", "T", 0.3), ("SpliceAI=.|X|0.7|0|0|0", 1, "A", "T", 0.7),
        ("SpliceAI=.|X|0.7|0|0|0", 2, "A", "T", None), ("SpliceAI=T|X|0.7|bad|0|0", 1, "A", "T", None), ("SpliceAI=T|X|0.7|0|0", 1, "A", "T", None), ("SpliceAI=C|X|0.7|0|0|0,T|X|0.11|0|0|0", 2, "A", "T", 0.11), ("SpliceAI=T|X|.|.|.|.", 1, "A", "T", None),
    ],
)
def test_splice_score(spark, info, alts, ref, alt, score):
    df = spark.createDataFrame([(info, ref, alt)], "info string, ref string, alt string")
    assert df.select(vcf.splice_score(F.col("info"), F.col("ref"), F.col("alt"), F.lit(alts))).first()[0] == score


def test_significance_scores(spark):
    from locusframe.plans.case_queries import VERDICT_TEXTS

    rows = spark.createDataFrame(VERDICT_TEXTS, "t string, tier string, score double").select("tier", "score", hgvs.significance_tier(F.col("t")).alias("s")).collect()
    assert all((r.s.tier, r.s.score) == (r.tier, r.score) for r in rows)


def test_text_phase_sets(spark):
    rows = [("s", "G", "1", 10, "A", "G", "0|1", "a1", 1), ("s", "G", "1", 20, "A", "G", "1|0", "b2", 2), ("s", "H", "1", 10, "A", "G", "0|1", "a1", 3), ("s", "H", "1", 20, "A", "G", "1|0", "a1", 4)]
    df = spark.createDataFrame(rows, "sample_id string, gene string, chrom string, pos long, ref string, alt string, gt string, ps string, ord long")
    assert {r.gene: r.state for r in classify.phase_states(df, "ord").collect()} == {"G": "unphased", "H": "trans"}


def test_frequency_keys(spark):
    texts = ["AF=;gnomAD_AF=0.5", "AF=.;gnomAD_AF=0.5", "gnomAD_AF=0.1;AF=0.2", "XAF=0.1", "AF=x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(vcf.allele_frequency(F.col("t"), F.lit(0))).collect()
    assert [r[0] for r in rows] == [0.5, None, 0.1, None, None]


def test_fasta_lines_are_trimmed(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">G1 x\n MK \nR0\t\n>G2\nA1C\n")
    assert {(r.gene, r.seq) for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {("G1", "MKR0"), ("G2", "A1C")}


def test_genotypes_without_lambdas(spark):
    """Called alleles, alternatives and the given alternative on all copies, as the list of allele numbers has them."""
    texts = ["0/0", "0/1", "1|0", "1/1", "2|2", "1/2", "./1", ".", "./.", ".|.", "1", "0", "", "x/1", "1/1/1", "1/.", "01/1", "10/1", "-1/1", "1/", None]
    rows = spark.createDataFrame([(t,) for t in texts], "g string").select("g", vcf.genotype_alleles(F.col("g")).alias("a"), vcf.called_alleles(F.col("g")).alias("c"), vcf.has_alternative(F.col("g")).alias("h"), vcf.is_biallelic(F.col("g"), F.lit(1)).alias("b"), vcf.zygosity(F.col("g")).alias("z")).collect()
    for r in rows:
        called = [x for x in r.a or [] if x is not None]
        assert (r.c or []) == called and r.h == any(x > 0 for x in called) and r.b == (len(r.a or []) >= 2 and all(x == 1 for x in r.a)), r.g
        kinds = set(called)
        want = "Unknown" if not r.g else "No-call" if r.g in (".", "./.", ".|.") else "Unknown" if not called else ("Ref" if called[0] == 0 else "Hem") if len(called) == 1 else ("Hom-Ref" if kinds == {0} else "Hom") if len(kinds) == 1 else "Het"
        assert r.z == want, r.g
