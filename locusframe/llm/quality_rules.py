"""Operator 6: a rule bitmask ledger for document quality.

Every rule is evaluated once a document; its failure is one bit of ``failed`` beside the measurements it used. Policies
are versioned sets of bits, applied later without reading the text, and ablations are bitwise sums over the ledger.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import text_batches

_SYMBOLS = b"#*$%&|<>"  # fixed values of the contract
_SPACE = b" \t\n\v\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))

#: Measurements, all counts over the whole text: integers, so that rules compare without rounding.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule name -> SQL condition under which a document fails. The place in this list is the rule's bit; append only.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 1000000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 4 * n_lines",
}
BASE_RULES = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules. A document that fails none of them is kept."""

    name: str
    version: int
    rules: tuple[str, ...] = field(default=tuple(RULES))

    @property
    def mask(self) -> int:
        return rule_mask(self.rules)


def rule_mask(rules) -> int:
    """The bits of the named rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


#: From version 2 on a text doesn't fail for being long; its bit stays in the ledger.
POLICIES = {("strict", 1): Policy("strict", 1), ("strict", 2): Policy("strict", 2, tuple(r for r in RULES if r != "many_words")), ("base", 1): Policy("base", 1, BASE_RULES)}
#: What op6 reports (its SQL tells ``kept`` by all seven bits), and what filtering goes by.
DEFAULT_POLICY = POLICIES["strict", 1]
FILTER_POLICY = POLICIES["strict", 2]


def repeated_window_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window found twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    at = np.array(list(map(known.setdefault, words, range(n))), dtype=np.int64)  # a word's first place is its number
    pair = at[:-2] * n + at[1:-1]
    if n < 2_000_000:
        window = pair * n + at[2:]
    else:
        window = np.unique(pair, return_inverse=True)[1] * n + at[2:]
    order = np.sort(window)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(window, twice)
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : k + n - 2] |= hit
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The MEASURES of one UTF-8 text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _CONTINUATION + _SPACE)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches, 1):
        rows = np.array([measure(t or b"") for t in texts], dtype=np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, i]) for i in range(len(MEASURES))]], ["key", *MEASURES])


def failure_bits(rules: Mapping[str, str] = RULES) -> Column:
    """The rules' conditions over the measurements as one long."""
    bits = [F.when(F.expr(test), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, test in enumerate(rules.values())]
    return sum(bits[1:], bits[0])


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, the measurements and ``failed`` (bit i: rule i failed).

    One pass without a shuffle; null and empty texts have zero measurements (and so fail few_words), null keys and
    repeated rows pass through, other columns are ignored. Memory is that of one text and a few numbers a word.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    rows = source.mapInArrow(_measured, f"key {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return rows.withColumn("failed", failure_bits()).withColumnRenamed("key", key)


def apply_policy(entries: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``base_failed`` (a base rule failed) and ``kept`` (no rule of the base or the policy failed)."""
    failed = F.col("failed")
    base = failed.bitwiseAND(F.lit(rule_mask(BASE_RULES))) != 0
    return entries.withColumns({"base_failed": base, "kept": ~base & (failed.bitwiseAND(F.lit(policy.mask)) == 0), "policy": F.lit(f"{policy.name}@{policy.version}")})


def ablations(entries: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """One row a rule of the policy: documents failing it, failing it alone (kept again without it), and kept with it.

    The ledger is first summed by its bits, at most 2^rules rows however many documents there are.
    """
    sums = entries.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(rule_mask([r])).alias("bit")) for r in policy.rules])
    each = sums.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failing"),
        count(F.col("bits") == F.col("bit")).alias("failing_alone"),
        count(F.col("bits") == 0).alias("kept"),
    )


def keep_good(docs: DataFrame, policy: Policy = FILTER_POLICY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that the policy rejects: the same rules and bits, all columns kept, no join."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = docs.columns.index(text)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, at):
            rows = np.array([measure(t or b"") for t in texts], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(rows[:, i]) for i in range(len(MEASURES))]], [*names, *MEASURES])

    kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True)]
    rows = plain.mapInArrow(judged, ", ".join([*kinds, *[f"{m} bigint" for m in MEASURES]])).withColumn("failed", failure_bits())
    return apply_policy(rows, policy).where("kept").select(names).toDF(*docs.columns)
