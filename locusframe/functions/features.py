"""Numeric features of variants and sequences as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"
#: Composition, polarity and volume of each amino acid (Grantham 1974): fixed values.
GRANTHAM = {
    "S": (1.42, 9.2, 32.0), "R": (0.65, 10.5, 124.0), "L": (0.0, 4.9, 111.0), "P": (0.39, 8.0, 32.5), "T": (0.71, 8.6, 61.0),
    "A": (0.0, 8.1, 31.0), "V": (0.0, 5.9, 84.0), "G": (0.74, 9.0, 3.0), "I": (0.0, 5.2, 111.0), "F": (0.0, 5.2, 132.0),
    "Y": (0.20, 6.2, 136.0), "C": (2.75, 5.5, 55.0), "H": (0.58, 10.4, 96.0), "Q": (0.89, 10.5, 85.0), "N": (1.33, 11.6, 56.0),
    "K": (0.33, 11.3, 119.0), "D": (1.38, 13.0, 54.0), "E": (0.92, 12.3, 83.0), "M": (0.0, 5.7, 105.0), "W": (0.13, 5.4, 170.0),
}
#: Side-chain charge: fixed values.
CHARGE = {"R": 1.0, "K": 1.0, "H": 0.1, "D": -1.0, "E": -1.0}


def complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(complement(sequence))


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC").cast("int")


def one_hots(ref: Column, alt: Column, strand: Column | None = None) -> dict[str, Column]:
    """Eight flags; with a strand they are read on the coding strand."""
    turn = (lambda b: F.when(strand == "-", complement(b)).otherwise(b)) if strand is not None else (lambda b: b)
    start = "cs_" if strand is not None else ""
    return {f"{start}{n}_{b}": (turn(c) == b).cast("int") for n, c in (("ref", ref), ("alt", alt)) for b in BASES}


def relative_position(pos: Column, length: Column, kind: Column | None = None) -> Column:
    """Place in the protein from 0 to 1; a position that isn't given is 0, of a lost stop 1 (with ``kind``)."""
    unknown = F.lit(0.0) if kind is None else F.when(kind == "stop_lost", 1.0).otherwise(0.0)
    return F.when(pos <= 0, unknown).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), pos / length)))


def pair_table(spark: SparkSession) -> DataFrame:
    """(ref_aa, alt_aa, distance, delta_charge): the 400 pairs, rounded as binary numbers are."""
    def distance(a: str, b: str) -> float:
        c, p, v = ((x - y) ** 2 for x, y in zip(GRANTHAM[a], GRANTHAM[b], strict=True))
        return round(50.723 * math.sqrt(1.833 * c + 0.1018 * p + 0.000399 * v), 1)

    rows = [(a, b, distance(a, b), round(CHARGE.get(b, 0.0) - CHARGE.get(a, 0.0), 3)) for a in GRANTHAM for b in GRANTHAM]
    return spark.createDataFrame(rows, "ref_aa string, alt_aa string, distance double, delta_charge double")


def change_kind(kind: Column, ref_aa: Column, alt_aa: Column) -> Column:
    """How a change counts in features: start_lost, stop_lost, exchange (two standard residues), stop, or null for no protein change."""
    standard = list(GRANTHAM)
    return (
        F.when(kind.isin("start_lost", "stop_lost"), kind).when(ref_aa.isin(standard) & alt_aa.isin(standard), "exchange")
        .when(F.coalesce(ref_aa == "*", F.lit(False)) | F.coalesce(alt_aa == "*", F.lit(False)) | (kind == "nonsense"), "stop")
    )


def severity(kind: Column, distance: Column, ref_aa: Column, alt_aa: Column) -> Column:
    """A pair's distance (100 if unknown) with its overrides: start lost 215, stops 200, no protein change 0."""
    change = change_kind(kind, ref_aa, alt_aa)
    return F.when(change == "start_lost", 215.0).when(change.isin("stop_lost", "stop"), 200.0).when(change == "exchange", F.coalesce(distance, F.lit(100.0))).otherwise(0.0)


def property_delta(change: Column, ref_value: Column, alt_value: Column, met_value: Column | float) -> Column:
    """Alternative minus reference of a residue property: a lost start loses methionine, a lost stop gains a residue, a stop loses one."""
    lost = F.lit(met_value) if not isinstance(met_value, Column) else met_value
    return (
        F.when(change == "start_lost", -lost).when(change == "stop_lost", F.coalesce(alt_value, F.lit(0.0)))
        .when(change == "exchange", F.round(alt_value - ref_value, 3)).when(change == "stop", F.coalesce(-ref_value, F.lit(0.0))).otherwise(0.0)
    )


def centred_window(sequence: Column, pos: Column, longest: int = 1022) -> tuple[Column, Column]:
    """(window, 0-based place of ``pos`` in it) of at most ``longest`` residues round the 1-based ``pos``."""
    length = F.length(sequence)
    start = F.when(length <= longest, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(pos - 1 - longest // 2, length - longest)))
    return F.substring(sequence, (start + 1).cast("int"), F.lit(longest)), (pos - 1 - start).cast("int")


def residue_status(sequence: Column, pos: Column, ref: Column) -> Column:
    return F.when(sequence.isNull(), "missing").when((ref == "*") & (pos == F.length(sequence) + 1), "stop_site").when((pos < 1) | (pos > F.length(sequence)), "out_of_bounds").when(F.substring(sequence, pos, F.lit(1)) == ref, "matched").otherwise("mismatch")


def base_counts(sequence: Column) -> Column:
    """struct(a, c, g, t) of a text's bases; select it before ``base_entropy`` reads it, so that it is counted once."""
    return F.struct(*[(F.length(sequence) - F.length(F.replace(sequence, F.lit(b), F.lit("")))).alias(b.lower()) for b in BASES])


def base_entropy(counts: Column) -> Column:
    """1 - H / 2 of a base composition (``base_counts``), 0.5 without bases."""
    each = [F.coalesce(counts[b.lower()], F.lit(0)) for b in BASES]
    total = each[0] + each[1] + each[2] + each[3]
    share = lambda c: F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0)
    return F.when(total > 0, 1 - (share(each[0]) + share(each[1]) + share(each[2]) + share(each[3])) / 2).otherwise(0.5)


def motif_score(alt: Column) -> Column:
    return F.when(alt == "A", 0.85).when(alt == "T", 0.65).when(alt == "G", 0.45).otherwise(0.35)


def score_tier(score: Column) -> Column:
    return F.when(score >= 0.90, "Pathogenic").when(score >= 0.70, "Likely Pathogenic").when(score >= 0.30, "VUS").when(score >= 0.10, "Likely Benign").otherwise("Benign")


def logistic(logit: Column, scale: float = 1.0, bias: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-(logit * scale + bias)))


def masked_llr(scores: Column, ref: Column, alt: Column) -> Column:
    """struct(llr, available): log p(alt) - log p(ref) of a position's score map, 0 and 0 if either is absent; 'Ter' is '*'."""
    key = lambda c: F.when(c == "Ter", "*").otherwise(c)
    llr = F.try_element_at(scores, key(alt)) - F.try_element_at(scores, key(ref))
    return F.struct(F.coalesce(llr, F.lit(0.0)).alias("llr"), llr.isNotNull().cast("int").alias("available"))
