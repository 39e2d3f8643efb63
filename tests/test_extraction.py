"""Extraction stages and legacy expressions on hand-made rows."""

from pyspark.sql import functions as F

from locusframe.functions import legacy
from locusframe.operators import extraction

GOOD = {"symbols": "AB1", "assembly": "GRCh38", "origin": "germline", "significance": "Pathogenic", "review": "reviewed by expert panel", "ref": "A", "alt": "G", "name": "NM_1.2(AB1):c.5A>G (p.Lys5Arg)", "chrom": "1", "pos": 5}
CHANGES = {
    "not_in_panel": {"symbols": "ZZ9"}, "ambiguous_gene": {"symbols": "AB1;CD2"}, "assembly": {"assembly": None}, "origin": {"origin": "somatic"}, "no_alleles": {"alt": None}, "same_alleles": {"alt": "A"},
    "not_snv": {"alt": "GA"}, "low_stars": {"review": None}, "foreign_gene": {"name": "NM_1.2(CD2):c.5A>G"}, "kept": {},
}


def rows(spark, changes):
    schema = "symbols string, assembly string, origin string, significance string, review string, ref string, alt string, name string, chrom string, pos long, ord long"
    return spark.createDataFrame([tuple((GOOD | c | {"ord": i}).values()) for i, c in enumerate(changes)], schema)


def test_first_failing_stage(spark):
    told = extraction.told(rows(spark, CHANGES.values()), ["AB1", "CD2"])
    found = {r.ord: r.stage for r in told.select("ord", extraction.drop_reason().alias("stage")).collect()}
    assert [found[i] for i in range(len(CHANGES))] == list(CHANGES)


def test_conflicting_indels_go_and_empty_input_holds(spark):
    told = extraction.told(rows(spark, [{"alt": "GA", "significance": "Conflicting"}, {"alt": "GA"}]), ["AB1"])
    assert [r[0] for r in told.orderBy("ord").select(extraction.drop_reason(indels=True)).collect()] == ["conflicting_indel", "kept"]
    assert extraction.funnel(rows(spark, CHANGES.values()).where("false"), ["AB1"]).count() == 0


def test_keep_first_and_manifest(spark):
    found = extraction.extract(rows(spark, [{}, {"significance": "Benign"}, {"pos": 6, "significance": "Benign"}]), ["AB1"], "ord")
    assert sorted((r.pos, r.label) for r in found.collect()) == [(5, 1), (6, 0)]
    panel = spark.createDataFrame([("AB1",), ("CD2",)], "gene string")
    manifest = extraction.gene_manifest(found, panel, "ord")
    assert sorted((r.gene, r.pathogenic, r.benign, r.primary_transcript) for r in manifest.collect()) == [("AB1", 1, 1, "NM_1.2"), ("CD2", 0, 0, None)]
    assert extraction.manifest_json(manifest).first()[0].startswith('{"pathogenic":1,"benign":1')


def test_codons(spark):
    context = "T" * 8 + "GCATG" + "C" * 8  # the middle base, number 11, is the A
    made = spark.createDataFrame([(context, p, s) for p in (1, 2, 3) for s in "+-"], "c string, p long, s string")
    codons = [r[0] for r in made.select(legacy.phased_codon(F.col("c"), F.col("p"), F.col("s"))).collect()]
    assert codons == ["ATG", "CAT", "CAT", "ATG", "GCA", "TGC"]
    amino = spark.createDataFrame([("ATG",), ("TAA",), ("NNN",), (None,), ("",)], "c string").select(legacy.translate_codon(F.col("c"))).collect()
    assert [r[0] for r in amino] == ["M", "*", "X", "X", "X"]
