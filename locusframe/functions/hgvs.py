"""Variant names and registry texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amino acids, variant classes in the order of their ids, review phrases.
AMINO_ACIDS = {"Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I", "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V", "Ter": "*", "Sec": "U"}
VARIANT_CLASSES = ["synonymous", "missense", "nonsense", "start_lost", "stop_lost", "splice_canonical", "splice_region", "intronic", "utr5", "utr3", "other_noncoding", "coding_no_protein_annot"]
REVIEW_STARS = {
    "practice guideline": 4,
    "reviewed by expert panel": 3,
    "criteria provided, multiple submitters, no conflicts": 2,
    "criteria provided, single submitter": 1,
    "criteria provided, conflicting classifications": 1,
    "criteria provided, conflicting interpretations": 1,
}
# The patterns that define which names are understood.
PROTEIN = r"\(p\.([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2}|=|\*|\?)\)"
FRAMESHIFT = r"\(p\.[A-Z][a-z]{2}\d+[A-Za-z]{0,3}fs"
TRANSCRIPT = r"^[NX][MR]_\d+\.\d+"
CODING = r":c\.([-*]?)(\d+)([+-]\d+)?"
GENE = r"\(([A-Z][A-Z0-9]+)\):c\."
SUBSTITUTION = r":c\.(\d+)([ACGT])>([ACGT])"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def one_letter(code: Column) -> Column:
    """Three letters to one; '?' for unknown ones."""
    return F.coalesce(F.try_element_at(literal_map(AMINO_ACIDS), code), F.lit("?"))


def amino_code(text: Column) -> Column:
    """One or three letters to one letter, else null."""
    short = F.when(F.length(text) == 1, F.upper(text))
    known = F.array(*[F.lit(x) for x in AMINO_ACIDS.values()])
    return F.coalesce(F.when(F.array_contains(known, short), short), F.try_element_at(literal_map(AMINO_ACIDS), F.initcap(text)))


def classify_name(name: Column) -> Column:
    """struct(variant_class, ref_aa, alt_aa, aa_pos): protein change first, then frameshift, then coding position.

    Names that say nothing are other_noncoding, a null name too; amino acids are '.' and the position 0 where there are none.
    """
    name = F.coalesce(name, F.lit(""))
    part = lambda i: F.regexp_extract(name, PROTEIN, i)
    ref3, alt3, pos = part(1), part(3), F.try_to_number(part(2), F.lit("9999999999")).cast("int")
    coding = lambda i: F.regexp_extract(name, CODING, i)
    offset = F.abs(F.nullif(coding(3), F.lit("")).try_cast("int"))
    made = lambda kind, ref, alt, at: F.struct(F.lit(kind).alias("variant_class"), ref.alias("ref_aa"), alt.alias("alt_aa"), at.alias("aa_pos"))
    none = lambda kind: made(kind, F.lit("."), F.lit("."), F.lit(0))
    ref, alt = one_letter(ref3), one_letter(alt3)
    first_met = (ref3 == "Met") & (pos == 1)
    protein = (
        F.when((ref3 == "Ter") & ~alt3.isin("Ter", "*", "="), made("stop_lost", F.lit("*"), alt, pos))
        .when(alt3 == "=", made("synonymous", ref, ref, pos))
        .when(alt3.isin("Ter", "*"), made("nonsense", ref, F.lit("*"), pos))
        .when((alt3 == "?") & first_met, made("start_lost", ref, F.lit("?"), pos))
        .when(alt3 == "?", made("protein_unknown", ref, F.lit("?"), pos))
        .when(first_met, made("start_lost", ref, alt, pos))
        .otherwise(made("missense", ref, alt, pos))
    )
    return (
        F.when(ref3 != "", protein)
        .when(name.rlike(FRAMESHIFT), none("frameshift"))
        .when(coding(2) == "", none("other_noncoding"))
        .when(coding(1) == "-", none("utr5"))
        .when(coding(1) == "*", none("utr3"))
        .when(offset <= 2, none("splice_canonical"))
        .when(offset <= 8, none("splice_region"))
        .when(offset.isNotNull(), none("intronic"))
        .otherwise(none("coding_no_protein_annot"))
    )


def class_id(kind: Column) -> Column:
    """0-based id of a variant class; that of other_noncoding for names outside the vocabulary."""
    ids = {c: i for i, c in enumerate(VARIANT_CLASSES)}
    return F.coalesce(F.try_element_at(literal_map(ids), kind), F.lit(ids["other_noncoding"]))


def review_stars(status: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(REVIEW_STARS), F.lower(F.trim(status))), F.lit(0))


def significance_label(text: Column) -> Column:
    """1 pathogenic, 0 benign, 2 uncertain, -1 conflicting or other; plain substrings count, as in 'pathogenicity'."""
    low = F.lower(F.coalesce(text, F.lit("")))
    path, benign, conflict, unsure = (low.contains(w) for w in ("pathogenic", "benign", "conflict", "uncertain"))
    return F.when(path & ~(conflict | unsure | benign), 1).when(benign & ~(conflict | unsure | path), 0).when(unsure & ~(conflict | path | benign), 2).otherwise(-1)


def significance_tier(text: Column) -> Column:
    """struct(tier, score) of a registry's verdict; here words must stand alone, and only the phrase 'likely pathogenic' (or
    'likely benign') makes a verdict a likely one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    word = lambda w: low.rlike(rf"\b{w}\b")
    path, benign = word("pathogenic"), word("benign")
    made = lambda tier, score: F.struct(F.lit(tier).alias("tier"), F.lit(score).alias("score"))
    return (
        F.when(low.contains("conflicting") | low.contains("uncertain") | low.contains("vus") | (path & benign), made("VUS", 0.5))
        .when(path & low.contains("likely pathogenic"), made("Likely Pathogenic", 0.95))
        .when(path, made("Pathogenic", 0.999))
        .when(benign & low.contains("likely benign"), made("Likely Benign", 0.05))
        .when(benign, made("Benign", 0.001))
        .otherwise(made("VUS", 0.5))
    )


def name_gene(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, GENE, 1), F.lit(""))


def name_transcript(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, TRANSCRIPT, 0), F.lit(""))


def substitution(name: Column) -> Column:
    """struct(cpos, ref, alt) of a coding substitution, null for other names."""
    place = lambda t: F.substring(t, F.lit(4), F.length(t) - 6).try_cast("int")
    made = lambda t: F.when(t != "", F.struct(place(t).alias("cpos"), F.substring(t, -3, 1).alias("ref"), F.substring(t, -1, 1).alias("alt")))
    return F.get(F.transform(F.array(F.regexp_extract(name, SUBSTITUTION, 0)), made), F.lit(0))  # searched once: :c.12A>C


def single_panel_hit(symbols: Column, panel: list[str]) -> Column:
    """The one symbol of the list that is in the panel; null for none, AMBIGUOUS for more."""
    hits = F.filter(F.split(symbols, ";"), lambda s: s.isin(panel))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).when(F.size(hits) > 1, F.lit("AMBIGUOUS"))
