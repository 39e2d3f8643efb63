"""Checks of a labelled variant table: one row a check with the number of rows or groups against it."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions import hgvs
from locusframe.functions.features import complement
from locusframe.functions.legacy import CODON_AMINO_ACIDS, CODON_BASES

#: A genomic substitution in a name.
GENOMIC = r"g\.(\d+)([ACGT])>([ACGT])"


def row_checks(rows: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(check, against): rows that fail each SQL condition, in one pass."""
    counts = rows.agg(*[F.count_if(~F.coalesce(F.expr(t), F.lit(False))).alias(n) for n, t in checks.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("against")) for n in checks])).alias("c")).select("c.*")


def repeated_keys(rows: DataFrame, key: list[str], name: str = "repeated_keys") -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).agg(F.lit(name).alias("check"), F.count_if(F.col("n") > 1).alias("against"))


def several_values(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Groups with more than one distinct value."""
    return rows.groupBy(*group).agg(F.min(value).alias("a"), F.max(value).alias("b")).agg(F.lit(name).alias("check"), F.count_if(F.col("a") != F.col("b")).alias("against"))


def in_several(tables: list[DataFrame], key: list[str], name: str = "in_several_outputs") -> DataFrame:
    """Keys that stand in more than one table."""
    every = reduce(DataFrame.unionByName, [t.select(*key).distinct() for t in tables])
    return repeated_keys(every, key, name)


def suite(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def parity(stored: DataFrame, recomputed: DataFrame, key: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(column, differing) between stored and recomputed features."""
    joined = stored.alias("a").join(recomputed.alias("b"), key)
    counts = joined.agg(*[F.count_if(~F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tolerance, F.col(f"a.{c}").isNull() & F.col(f"b.{c}").isNull())).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("differing")) for c in columns])).alias("c")).select("c.*")


def counts_match(rows: DataFrame, manifest: DataFrame, label: str = "label", name: str = "counts_match") -> DataFrame:
    """Labels whose number of rows differs from the manifest's (label, n), on either side."""
    own = rows.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    told = manifest.select(F.col("label").alias("_t"), F.col("n").alias("_m"))
    both = own.join(told, F.col("_l").eqNullSafe(F.col("_t")), "full")
    return both.agg(F.lit(name).alias("check"), F.count_if(~F.coalesce(F.col("_n") == F.col("_m"), F.lit(False))).alias("against"))


def cardinalities(rows: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """One check a column: 1 if its number of distinct values isn't the wanted one."""
    found = rows.agg(*[F.countDistinct(c).alias(c) for c in wanted])
    parts = [F.struct(F.lit(f"distinct_{c}").alias("check"), (F.col(c) != n).cast("bigint").alias("against")) for c, n in wanted.items()]
    return found.select(F.explode(F.array(*parts)).alias("c")).select("c.*")


def named(rows: DataFrame) -> DataFrame:
    """``rows`` (hgvs_name, ref, alt, gene) with what their names say: cdna (cpos, ref, alt), named_gene, and whether the
    name's alleles are the variant's (``plus``) or their complements (``minus``); null without a coding substitution of the gene."""
    cdna, gene = hgvs.substitution(F.col("hgvs_name")), hgvs.name_gene(F.col("hgvs_name"))
    told = rows.withColumns({"cdna": cdna, "named_gene": gene})
    own = F.col("cdna").isNotNull() & F.coalesce(F.col("named_gene") == F.col("gene"), F.lit(True))
    same = lambda turn: F.when(own, (F.col("cdna.ref") == turn(F.col("ref"))) & (F.col("cdna.alt") == turn(F.col("alt"))))
    return told.withColumns({"plus": same(lambda c: c), "minus": same(complement)})


def codon_changes() -> list[tuple[str, int, str, str, str]]:
    """(ref_aa, place, ref, alt, alt_aa) of every single-base change of every codon, from the genetic code."""
    code = {"".join(c): a for c, a in zip(itertools.product(CODON_BASES, repeat=3), CODON_AMINO_ACIDS, strict=True)}
    return sorted({(a, i, c[i], b, code[c[:i] + b + c[i + 1 :]]) for c, a in code.items() for i in range(3) for b in CODON_BASES if b != c[i]})


PROTEIN_CLASSES = ("missense", "synonymous", "nonsense", "start_lost")


def protein_rows(rows: DataFrame, kinds: tuple[str, ...] = PROTEIN_CLASSES) -> DataFrame:
    """Rows of the classes that change or name a residue."""
    return rows.where(F.col("variant_class").isin(*kinds))


def fix_stop_lost(rows: DataFrame) -> DataFrame:
    """``rows`` with what is called missense but starts from a stop as stop_lost."""
    stop = (F.col("variant_class") == "missense") & (F.col("ref_aa") == "*")
    return rows.withColumn("variant_class", F.when(stop, "stop_lost").otherwise(F.col("variant_class")))


def name_checks(rows: DataFrame) -> DataFrame:
    """Checks of labelled variants against their names, one row a check.

    label_text: the label isn't what the significance says. alleles: neither the variant's alleles nor their complements
    stand in the name. strands: genes named on both strands. residue_place: aa_pos isn't the codon of the coding
    position. reachable: the residues aren't one base change of a codon apart, with that base at that place.
    missense_stop: missense from a stop. foreign_gene: names of another gene. genomic_name: a genomic name with other
    position or alleles.
    """
    told = named(rows).withColumn("_genomic", F.regexp_extract("hgvs_name", GENOMIC, 0))  # g.12A>C
    label = hgvs.significance_label(F.col("clinical_significance"))
    genomic = F.col("_genomic")
    is_genomic = (genomic != "") & F.col("cdna").isNull()
    place = F.substring(genomic, F.lit(3), F.length(genomic) - 5).try_cast("bigint")
    same = (place == F.col("pos")) & (F.substring(genomic, -3, 1) == F.col("ref")) & (F.substring(genomic, -1, 1) == F.col("alt"))
    protein = F.col("variant_class").isin(*PROTEIN_CLASSES) & (F.col("plus") | F.col("minus"))
    change = F.concat(*[c for part in ("ref_aa", F.pmod(F.col("cdna.cpos") - 1, F.lit(3)).cast("string"), "cdna.ref", "cdna.alt", "alt_aa") for c in (F.lit("|"), part)])
    reachable = F.coalesce(change.isin(["".join(f"|{x}" for x in c) for c in codon_changes()]), F.lit(False))
    counts = {
        "label_text": F.col("label").isin(0, 1) & (label != F.col("label")),
        "alleles": ~F.col("plus") & ~F.col("minus"),
        "missense_stop": (F.col("variant_class") == "missense") & (F.col("ref_aa") == "*"),
        "foreign_gene": F.col("cdna").isNotNull() & (F.col("named_gene") != F.col("gene")),
        "genomic_name": is_genomic & ~F.coalesce(same, F.lit(False)),
        "residue_place": protein & (F.floor((F.col("cdna.cpos") - 1) / 3) + 1 != F.col("aa_pos")),
        "reachable": protein & ~reachable,
    }
    # one pass: counts by gene, then their sums
    genes = told.groupBy("gene").agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in (counts | {"_p": F.col("plus"), "_m": F.col("minus")}).items()])
    strands = F.count_if((F.col("_p") > 0) & (F.col("_m") > 0)).alias("strands")
    flat = genes.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts], strands)
    return flat.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("against")) for n in [*counts, "strands"]])).alias("c")).select("c.*")


def far_from_gene(rows: DataFrame, extents: DataFrame, most: int = 50_000, name: str = "far_from_gene") -> DataFrame:
    """Rows on another chromosome than their gene's extent (gene, chrom, start, end), or over ``most`` bases outside it."""
    at = extents.select("gene", F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    away = F.greatest(F.col("_s") - F.col("pos"), F.col("pos") - F.col("_e"), F.lit(0))
    return rows.join(at, "gene").agg(F.lit(name).alias("check"), F.count_if((F.col("chrom") != F.col("_c")) | (away > most)).alias("against"))


def bounds(genes: DataFrame, least: int = 30, most: int = 40_000) -> DataFrame:
    """Genes without a strand, or with a length that no protein has."""
    return row_checks(genes, {"strand": "strand in ('+', '-')", "length": f"length between {least} and {most}"})
