"""Work a row: texts are searched once, tables read once, and rows that have their gene aren't shuffled again."""

from pyspark.sql import functions as F

from locusframe.functions import vcf
from locusframe.operators import annotate, quality

INFO = "DB;XCSQ=T|x;CSQ=;CSQ=C|other|x|G1,t|missense|x|g1|||T1||||c.5A>G|p.K5R|||5|K/R;AF=0.5"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def first(spark, info, tag=("CSQ", vcf.CSQ_FIELDS)):
    df = spark.createDataFrame([(info, "A", "T")], "info string, ref string, alt string").withColumn("n_alts", F.length("alt"))
    return df.select(vcf.first_annotation(F.col("info"), *tag, F.col("ref"), F.col("alt"), F.col("n_alts"), ["G1"]).alias("a"), "info")


def test_info_texts_are_searched_once(spark):
    assert tuple(first(spark, INFO).first().a) == ("t", "missense", "G1", "T1", "c.5A>G", "p.K5R", "5", "K/R")
    assert all(first(spark, t).first().a is None for t in (None, "", "CSQ=", "XCSQ=T|x|x|G1", "CSQ=T|x|x", "CSQ=C|x|x|G1", "CSQ=T|x|x|G2"))
    assert first(spark, "A=1;CSQ=|x|x|G1").first().a.consequence == "x"
    infos = first(spark, INFO).select("info", F.lit("0/1").alias("gt"), F.col("info").alias("form"))
    assert plan(infos.select(vcf.zygosity(F.col("form")).alias("z"))).count("regexp_extract_all") == 1
    assert plan(infos.select(vcf.format_number(F.col("form"), F.col("info"), "DP").alias("n"))).count("array_position") == 1


def test_splice_deltas_with_spaces(spark):
    score = lambda t, n=1: spark.createDataFrame([(t,)], "i string").select(vcf.splice_score(F.col("i"), F.lit("A"), F.lit("T"), F.lit(n))).first()[0]
    assert score("SpliceAI= t | X | 0.1 | . |0.30|  ,C|X|0.9|0|0|0") == 0.3 and score("SpliceAI=T|X|0. 5|0|0|0") is None
    assert score("SpliceAI=T|X|x|0|0|0,T|X|0.2|0|0|0") == 0.2 and score("SpliceAI=T|X|.|.|.|.") is None and score("SpliceAI=T|X|.|.|.|.;ds_max=0.7") == 0.7 and score("ds_max=0.7", 2) is None


NAMES = "hgvs_name string, ref string, alt string, gene string, pos long, variant_class string, ref_aa string, alt_aa string, aa_pos int, clinical_significance string, label int"
ROWS = [
    ("NM_1.1(G1):c.4A>G", "A", "G", "G1", 9, "missense", "K", "E", 2, "Pathogenic", 1),  # AAA to GAA
    ("NM_1.1(G1):c.4A>G", "T", "C", "G1", 9, "missense", "*", "W", 3, "Benign", 1),
    ("NM_1.1(G1):c.5A>G", "C", "G", "G1", 9, "missense", None, "E", 2, None, None),
    ("NM_1.1(G2):c.5A>G", "A", "G", "G1", 9, None, "K", "E", 2, "Benign", 0),
    ("NC_1:g.009A>G", "A", "G", None, 9, "missense", "K", "E", 2, "x", 2),
    ("NC_1:g.8A>G", "A", "G", None, 9, "missense", "K", "E", 2, "x", 2),
    ("NM_1.1(G3):c.99999999999A>G", "A", "G", "G3", None, "missense", "K", "E", 2, "x", 2),
    (None, None, None, None, None, None, None, None, None, None, None),
]


def test_name_checks_read_the_table_once(spark, tmp_path):
    spark.createDataFrame(ROWS, NAMES).write.parquet(str(tmp_path / "names"))
    table = spark.read.parquet(str(tmp_path / "names"))
    made = quality.name_checks(table)
    assert {r.check: r.against for r in made.collect()} == {"label_text": 1, "alleles": 1, "missense_stop": 1, "foreign_gene": 1, "genomic_name": 1, "residue_place": 1, "reachable": 2, "strands": 1}
    assert plan(made).count("parquet") == 1
    assert {r.against for r in quality.name_checks(table.limit(0)).collect()} == {0}


def test_rows_with_a_gene_are_not_joined_again(spark):
    calls = [(i, "1", 10 * i, "A", "T", 1, "CSQ=T|missense|x|G1" if i % 2 else "DB") for i in range(1, 9)]
    calls = spark.createDataFrame(calls, "line long, chrom string, pos long, ref string, alt string, n_alts int, info string")
    known = spark.createDataFrame([("1", 20, "A", "T", "G2", "missense", 1)], "chrom string, pos long, ref string, alt string, gene string, variant_class string, ord long")
    places = spark.createDataFrame([("G3", "1", 35, 45), ("G4", "1", 55, 85), ("G5", "1", 75, 85)], "gene string, chrom string, start long, end long")
    got = annotate.attribute_genes(calls, known, places, ["G1"], ["line"], "ord")
    want = {1: ("G1", "csq"), 2: ("G2", "registry"), 3: ("G1", "csq"), 4: ("G3", "interval"), 5: ("G1", "csq"), 6: ("G4", "interval"), 7: ("G1", "csq"), 8: (None, None)}
    assert {r.line: (r.gene, r.gene_source) for r in got.collect()} == want
    assert not [x for x in plan(got).splitlines() if "Join" in x and "line#" in x]
