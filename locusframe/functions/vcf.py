"""Fields of variant calls as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of the two annotation formats, by place: fixed values.
CSQ_FIELDS = {"allele": 0, "consequence": 1, "symbol": 3, "transcript": 6, "hgvs_c": 10, "hgvs_p": 11, "position": 14, "residues": 15}
ANN_FIELDS = {"allele": 0, "consequence": 1, "symbol": 3, "transcript": 6, "hgvs_c": 9, "hgvs_p": 10}


def genotype_alleles(gt: Column) -> Column:
    """Called allele numbers, null for uncalled ones; null for no call at all."""
    bare = gt.isNull() | gt.isin(".", "./.", ".|.")
    return F.when(~bare, F.transform(F.split(gt, r"[/|]"), lambda a: F.when(a.rlike(r"^\d+$"), a.try_cast("int"))))


def called_alleles(gt: Column) -> Column:
    """The called allele numbers only, without a lambda, so in compiled code; empty for no call, null for null."""
    return F.regexp_extract_all(gt, F.lit(r"(?<![^/|])[0-9]{1,9}(?![^/|])"), F.lit(0)).cast("array<int>")


def has_alternative(gt: Column) -> Column:
    return F.coalesce(gt.rlike(r"(?<![^/|])0*[1-9][0-9]*(?![^/|])"), F.lit(False))


def is_biallelic(gt: Column, number: Column) -> Column:
    """Two alleles or more, all of them the given alternative."""
    alleles = called_alleles(gt)
    whole = (F.size(alleles) >= 2) & (F.size(alleles) == F.size(F.split(gt, r"[/|]")))
    return F.coalesce(whole & (F.array_min(alleles) == number) & (F.array_max(alleles) == number), F.lit(False))


def format_field(form: Column, sample: Column, name: str) -> Column:
    """A sample's value of a FORMAT key; null if absent or '.'."""
    return F.nullif(_format_text(form, sample, name), F.lit("."))


def _format_text(form: Column, sample: Column, name: str) -> Column:
    return F.get(F.split(sample, ":"), (F.array_position(F.split(form, ":"), name) - 1).cast("int"))


def format_number(form: Column, sample: Column, name: str) -> Column:
    return F.regexp_extract(_format_text(form, sample, name), r"^\d+$", 0).try_cast("int")


def info_text(info: Column, *keys: str) -> Column:
    """The value of the first of the keys that stands in the text with a value, else ''."""
    if len(keys) == 1:  # the key as the pattern's first letters, which the matcher skips to
        return F.regexp_extract(info, rf"{keys[0]}=(?<=(?:^|;){keys[0]}=)([^;]+)", 1)
    return F.regexp_extract(info, rf"(?:^|;)(?:{'|'.join(keys)})=([^;]+)", 1)


def info_value(info: Column, *keys: str) -> Column:
    return F.nullif(info_text(info, *keys), F.lit(""))


def allele_frequency(info: Column, alt_index: Column) -> Column:
    """Frequency of one alternative; null (not zero) if missing or not a number."""
    return F.get(F.split(info_text(info, "AF", "gnomAD_AF", "AF_raw"), ","), alt_index).try_cast("double")


def allele_matches(told: Column, ref: Column, alt: Column, n_alts: Column) -> Column:
    """Whether an annotation's allele means this alternative: equal, its minimal indel form, or unnamed with one alternative."""
    unnamed = told.isNull() | told.isin("", ".")
    short = F.when(F.length(alt) == 1, F.lit("-")).otherwise(F.substring(alt, 2, 2**31 - 1))
    return (told == alt) | ((n_alts == 1) & unnamed) | ((F.length(ref) != F.length(alt)) & (told == short))


def first_annotation(info: Column, tag: str, fields: dict[str, int], ref: Column, alt: Column, n_alts: Column, panel: list[str]) -> Column:
    """The first entry of CSQ or ANN for this allele with a symbol of the panel, as a struct of its fields; else null.

    Symbols are compared and returned in upper case. Entries are tested as text and the first that fits is cut into its
    fields; it is bound once, in a lambda, so that the fields don't repeat the search.
    """
    symbol = lambda e: F.upper(F.get(e, F.lit(fields["symbol"])))
    start = lambda e: F.split(e, r"\|", fields["symbol"] + 2)
    fits = lambda e: F.coalesce(allele_matches(F.upper(F.trim(F.substring_index(e, "|", 1))), ref, alt, n_alts) & symbol(start(e)).isin(panel), F.lit(False))
    value = lambda e, n, i: symbol(e) if n == "symbol" else F.nullif(F.get(e, F.lit(i)), F.lit(""))
    first = F.slice(F.filter(F.split(info_text(info, tag), ","), fits), 1, 1)
    made = F.transform(F.transform(first, lambda e: F.split(e, r"\|")), lambda e: F.struct(*[value(e, n, i).alias(n) for n, i in fields.items()]))
    return F.get(made, F.lit(0))


def splice_score(info: Column, ref: Column, alt: Column, n_alts: Column) -> Column:
    """The largest splice delta of this alternative; null without any.

    Entries of SpliceAI count if their allele is this one (upper case; unnamed with one alternative only). Empty and '.'
    deltas are skipped; an entry with a delta that isn't a number doesn't count. With one alternative the tags DS_MAX,
    SpliceAI_DS_max and SpliceAI_max count too, in any case. Deletions have no short form here, so ``ref`` isn't read.
    """
    told = info_text(info, "SpliceAI")
    trimmed = F.when(info.contains(" "), F.trim(F.regexp_replace(told, r" *([|,]) *", "$1"))).otherwise(told)
    entries = F.transform(F.split(trimmed, ","), lambda e: F.split(e, r"\|"))
    # array functions without lambdas of their own; in ascending order a delta that isn't a number, now null, comes first
    deltas = lambda e: F.array_remove(F.array_remove(F.slice(e, 3, 4), ""), ".").try_cast("array<double>")
    parsed = F.transform(entries, lambda e: F.struct(F.upper(F.get(e, F.lit(0))).alias("allele"), F.size(e).alias("n"), F.sort_array(deltas(e)).alias("deltas")))
    own = lambda e: F.when(e["allele"].isin("", "."), n_alts == 1).otherwise(e["allele"] == alt)
    whole = lambda e: (e["n"] >= 6) & F.get(e["deltas"], F.lit(0)).isNotNull() & own(e)
    best = F.array_max(F.transform(parsed, lambda e: F.when(whole(e), F.element_at(e["deltas"], -1))))
    tag = F.regexp_extract(info, r"(?i)(?:^|;)(?:DS_MAX|SpliceAI_DS_max|SpliceAI_max)=([0-9.]+)", 1).try_cast("double")
    return F.greatest(best, F.when((n_alts == 1) & F.lower(info).contains("_max="), tag))


def consequence_class(consequence: Column) -> Column:
    """Variant class of a consequence term; the first rule that holds decides."""
    low = F.lower(F.coalesce(consequence, F.lit("")))
    rules = [(("missense",), "missense"), (("synonymous",), "synonymous"), (("stop_gained", "nonsense"), "nonsense"), (("splice_donor", "splice_acceptor"), "splice_canonical"), (("splice",), "splice_region"), (("intron",), "intronic"), (("5_prime_utr", "utr5"), "utr5"), (("3_prime_utr", "utr3"), "utr3"), (("start_lost",), "start_lost"), (("stop_lost",), "stop_lost")]
    out = F.lit("other_noncoding")
    for words, kind in reversed(rules):
        out = F.when(low.rlike("|".join(words)), kind).otherwise(out)
    return out


def plain_chromosome(chrom: Column) -> Column:
    return F.replace(chrom, F.lit("chr"), F.lit(""))


def zygosity(gt: Column) -> Column:
    """No-call, Unknown, Ref, Hem, Hom-Ref, Hom or Het."""
    return F.get(F.transform(F.array(called_alleles(gt)), lambda alleles: _zygosity(gt, alleles)), F.lit(0))  # read once


def _zygosity(gt: Column, alleles: Column) -> Column:
    n, kinds = F.size(alleles), F.size(F.array_distinct(alleles))
    first = F.get(alleles, F.lit(0))
    return (
        F.when(gt.isNull() | (gt == ""), "Unknown").when(gt.isin(".", "./.", ".|."), "No-call").when(alleles.isNull() | (n == 0), "Unknown")
        .when((n == 1) & (first == 0), "Ref").when(n == 1, "Hem").when((kinds == 1) & (first == 0), "Hom-Ref").when(kinds == 1, "Hom").otherwise("Het")
    )


def phased_slot(gt: Column) -> Column:
    """Which haplotype (0-based) carries the only alternative of a phased genotype; else null."""
    carries = F.transform(F.split(gt, r"\|"), lambda a: F.coalesce(a.try_cast("int") > 0, F.lit(False)))
    return F.when(gt.contains("|") & (F.size(F.filter(carries, lambda x: x)) == 1), F.array_position(carries, True) - 1)


def alternative_count(gt: Column) -> Column:
    return F.size(F.filter(F.split(gt, r"[/|]"), lambda a: F.coalesce(a.try_cast("int") > 0, F.lit(False))))
