"""Expressions of earlier feature sets and report bands, kept for tables made with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.functions.features import reverse_complement

#: The standard genetic code, codons in the order TCAG of each base: a fixed value.
CODON_BASES = "TCAG"
CODON_AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate_codon(codon: Column) -> Column:
    """One-letter amino acid of a codon; 'X' for anything that isn't three of ACGT."""
    place = lambda i: F.instr(F.lit(CODON_BASES), F.substring(codon, i, 1)) - 1
    index = place(1) * 16 + place(2) * 4 + place(3)
    return F.when(codon.rlike("^[ACGT]{3}$"), F.substring(F.lit(CODON_AMINO_ACIDS), (index + 1).cast("int"), F.lit(1))).otherwise("X")


def phased_codon(context: Column, pos: Column, strand: Column) -> Column:
    """The codon that holds the middle base of a 21-base context, by (pos - 1) mod 3, read on the strand; 'ATG' if it is cut off."""
    start = 11 - F.pmod(pos - 1, F.lit(3))
    codon = F.when(F.length(context) >= start + 2, F.substring(context, start.cast("int"), F.lit(3))).otherwise("ATG")
    return F.when(strand == "-", reverse_complement(codon)).otherwise(codon)


def substitution_rates(synonymous: Column, gene_length: Column) -> Column:
    """struct(dn, ds, ratio) of one change over site counts of a quarter (silent) and three quarters of the gene."""
    changing, silent = F.greatest(F.lit(100.0), gene_length * 0.75), F.greatest(F.lit(30.0), gene_length * 0.25)
    dn = F.when(synonymous, 0.0).otherwise(F.round(1 / changing, 6))
    ds = F.when(synonymous, F.round(1 / silent, 6)).otherwise(0.0)
    ratio = F.when(synonymous, 0.0).otherwise(F.least(F.lit(9.999), F.round(dn * silent, 3)))
    return F.struct(dn.alias("dn"), ds.alias("ds"), ratio.alias("ratio"))


def risk_band(percent: Column) -> Column:
    """Four bands of a probability in per cent."""
    return F.when(percent >= 85, "high").when(percent >= 50, "moderate_high").when(percent >= 20, "uncertain").otherwise("low")


def first_bands(probability: Column) -> Column:
    """Five bands of the first feature set, by a probability."""
    return F.when(probability >= 0.90, "very_high").when(probability >= 0.65, "high").when(probability >= 0.35, "uncertain").when(probability >= 0.10, "low").otherwise("very_low")


def exchange_severity(distance: Column) -> Column:
    """How radical an amino acid exchange is; null for no exchange."""
    return F.when(distance >= 100, "radical").when(distance >= 50, "moderate").when(distance > 0, "conservative")


def expected_risk(probability: Column, penetrance: Column) -> Column:
    return probability * penetrance


def organ_risk(probability: Column, base: Column) -> Column:
    """Base risk scaled by a probability, never under 15 % of it nor over 99."""
    return F.least(F.lit(99.0), F.greatest(base * 0.15, base * probability))
