"""Readers with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.vcf import plain_chromosome
from locusframe.sources import bgzf

LABELLED = "variation_id string, gene string, syndrome_group string, chrom string, pos long, ref string, alt string, label int, clinical_significance string, review_status string, stars int, variant_class string, ref_aa string, alt_aa string, aa_pos int, transcript string, hgvs_name string, last_evaluated string, on_primary_transcript int"
PENETRANCE = "gene string, outcome string, risk_low_pct double, risk_high_pct double, up_to_age int, source string, evidence_level string"
REGISTRY_COLUMNS = ["GeneSymbol", "Assembly", "OriginSimple", "ClinicalSignificance", "ReviewStatus", "Type", "Name", "Chromosome", "PositionVCF", "ReferenceAlleleVCF", "AlternateAlleleVCF"]

_GRCH38 = r"GRCh38|hg38|hs38|GCA_000001405\.15|ID=(chr)?1,.*length=248956422"
_OLDER = r"GRCh37|hg19|hs37"


def text_lines(spark: SparkSession, paths, range_bytes: int = bgzf.RANGE_BYTES) -> DataFrame:
    """(value, sample_id, line) of text files: the file, and a number that grows within it.

    Files ending in .gz or .bgz that are block-gzipped are read in byte ranges, a task each; others as Spark reads them (a
    plain gzip file is one task). Folders and patterns are Spark's; name block-gzipped files one by one.
    """
    given = [paths] if isinstance(paths, str) else [str(p) for p in paths]
    packed = [p for p in given if p.endswith((".gz", ".bgz")) and "*" not in p and bgzf.is_bgzf(p)]
    plain = [p for p in given if p not in packed]
    parts = []
    if packed:
        parts.append(bgzf.read_lines(spark, packed, range_bytes).select("value", F.col("path").alias("sample_id"), "line"))
    if plain:
        parts.append(spark.read.text(plain).select("value", F.col("_metadata.file_path").alias("sample_id"), F.monotonically_increasing_id().alias("line")))
    return reduce(DataFrame.unionByName, parts)


def read_vcf(spark: SparkSession, paths, range_bytes: int = bgzf.RANGE_BYTES) -> DataFrame:
    """Site rows of plain, gzipped or block-gzipped VCF files, one a line; lines of under five fields are left out.

    ``sample_id`` is the file, ``line`` a number that grows within it. Missing QUAL is 100, missing FILTER '.'.
    """
    lines = text_lines(spark, paths, range_bytes)
    fields = F.split("value", "\t")
    at = lambda i: F.get(fields, F.lit(i))
    rows = lines.where(~F.col("value").startswith("#") & (F.size(fields) >= 5))
    return rows.select(
        "sample_id", "line", plain_chromosome(at(0)).alias("chrom"), at(1).try_cast("bigint").alias("pos"), at(2).alias("id"), F.upper(at(3)).alias("ref"), F.split(F.upper(at(4)), ",").alias("alts"),
        F.coalesce(at(5).try_cast("double"), F.lit(100.0)).alias("qual"), F.coalesce(at(6), F.lit(".")).alias("filter"), F.coalesce(at(7), F.lit("")).alias("info"), at(8).alias("format"), at(9).alias("sample"),
    )


def quarantined_lines(spark: SparkSession, paths) -> DataFrame:
    """(sample_id, line, fields, reason, value) of the data lines that ``read_vcf`` leaves out or can't place."""
    lines = text_lines(spark, paths)
    fields = F.split("value", "\t")
    reason = F.when(F.size(fields) < 5, "short").when(F.get(fields, F.lit(1)).try_cast("bigint").isNull(), "position")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumns({"fields": F.size(fields), "reason": reason})
    return rows.where("reason is not null").select("sample_id", "line", "fields", "reason", "value")


def assembly_of(spark: SparkSession, paths) -> DataFrame:
    """(sample_id, accepted, older) from each file's header: only GRCh38 files are accepted."""
    heads = text_lines(spark, paths).select("value", "sample_id").withColumn("head", F.col("value").startswith("##"))
    new, old = F.col("value").rlike(_GRCH38), F.col("value").rlike(_OLDER)
    return heads.groupBy("sample_id").agg(F.coalesce(F.bool_or(F.col("head") & new), F.lit(False)).alias("accepted"), F.coalesce(F.bool_or(F.col("head") & old & ~new), F.lit(False)).alias("older"))


def require_assembly(spark: SparkSession, paths) -> None:
    """Raises if a file is not on GRCh38; the message tells what to do."""
    if bad := assembly_of(spark, paths).where("not accepted").first():
        raise ValueError(f"{bad['sample_id']}: " + ("an older assembly; lift it over to GRCh38 first" if bad["older"] else "no reference assembly is named in its header"))


def read_registry(spark: SparkSession, path) -> DataFrame:
    """A tab-separated registry dump with a '#' header; raises on missing columns.

    Rows of fewer fields than the header are left out; an empty field is an empty text, not a short row.
    """
    lines = text_lines(spark, path)
    head = lines.where(F.col("value").startswith("#")).first()
    names = head["value"].lstrip("#").split("\t") if head else []
    if missing := [c for c in REGISTRY_COLUMNS if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    fields = lines.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= len(names))
    return fields.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(names)])


def read_labelled(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, schema=LABELLED, header=True)


def read_penetrance(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, schema=PENETRANCE, header=True)


def read_keyed_json(spark: SparkSession, path, fields: str, key: str = "gene") -> DataFrame:
    """A JSON object of objects as rows: its keys in ``key``, the fields as columns."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{fields}>>").alias("m"))
    return whole.select(F.explode("m").alias(key, "v")).select(key, "v.*")


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(header, gene, seq) of each record; the gene is the header's first word."""
    records = spark.read.text(path, lineSep=">").where("trim(value) <> ''").select(F.split("value", r"\r?\n").alias("lines"))
    header = F.get("lines", F.lit(0))
    return records.select(header.alias("header"), F.get(F.split(header, r"\s+"), F.lit(0)).alias("gene"), F.upper(F.concat_ws("", F.transform(F.expr("slice(lines, 2, size(lines))"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))).alias("seq"))


def fasta_header_fields(header):
    """(accession, gene) of a protein database's header."""
    part = lambda p: F.nullif(F.regexp_extract(header, p, 1), F.lit(""))
    return part(r"^(?:sp|tr)\|([^|]+)\|"), part(r"GN=(\S+)")


def key_values(header):
    """strand (default '+') and length (default 50000) of a 'key=value' header."""
    values = F.str_to_map(header, F.lit(" "), F.lit("="))
    return F.coalesce(F.try_element_at(values, F.lit("strand")), F.lit("+")), F.coalesce(F.regexp_replace(F.try_element_at(values, F.lit("length")), "bp$", "").try_cast("int"), F.lit(50000))


def read_score_cache(spark: SparkSession, path, embedding: bool = True) -> DataFrame:
    """(gene, aa_pos, scores[, embedding]) of a written score cache; only these columns are read."""
    return spark.read.parquet(path).select("gene", "aa_pos", "scores", *["embedding"] * embedding)
