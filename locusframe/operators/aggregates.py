"""Counting, voting and keep-first operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.ranks import dictionary


def funnel(rows: DataFrame, reason: Column, stages: list[str]) -> DataFrame:
    """(stage, dropped, left): one count a reason, then what is left after each stage in order."""
    counts = rows.groupBy(reason.alias("stage")).agg(F.count("*").alias("dropped"))
    order = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    after = Window.orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return counts.select("stage", "dropped", F.when(F.col("stage") == "kept", F.col("dropped")).otherwise(F.coalesce(F.sum("dropped").over(after), F.lit(0))).alias("left"))


def keep_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, without a window."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")


def duplicate_summary(rows: DataFrame, key: list[str], order: str, label: str) -> DataFrame:
    """(keys, duplicates, conflicts): conflicts are later rows whose label differs from the first one's."""
    window = Window.partitionBy(*key).orderBy(order)
    marked = rows.select(F.row_number().over(window).alias("n"), F.col(label).alias("l"), F.first(label).over(window).alias("f"))
    return marked.agg(F.count_if(F.col("n") == 1).alias("keys"), F.count_if(F.col("n") > 1).alias("duplicates"), F.count_if(F.col("l") != F.col("f")).alias("conflicts"))


def mode_by(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value, n): the most frequent value, the first seen of equals."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    # the least first place of the greatest number: min_by of a struct whose number is negative
    return counts.groupBy(group).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "_first")).alias("_m")).select(group, f"_m.{value}", "_m.n")


def strand_vote(rows: DataFrame, group: str, plus: Column, minus: Column) -> DataFrame:
    """(group, plus, minus, strand): a strand wins with more than twice the other's votes."""
    counts = rows.groupBy(group).agg(F.count_if(plus).alias("plus"), F.count_if(minus).alias("minus"))
    return counts.withColumn("strand", F.when(F.col("plus") + F.col("minus") == 0, "unknown").when(F.col("plus") > 2 * F.col("minus"), "+").when(F.col("minus") > 2 * F.col("plus"), "-").otherwise("ambiguous"))


def sparse_groups(rows: DataFrame, panel: DataFrame, group: str, least: int) -> DataFrame:
    """(group, n) of panel groups with under ``least`` rows, those without any included."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    return panel.select(group).distinct().join(counts, group, "left").select(group, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def depth_summary(rows: DataFrame, group: str, least: int, top: int) -> DataFrame:
    """(groups, sparse, median, top_share) over the sizes of groups."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    ranked = sizes.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), group)))  # a row a group
    return ranked.agg(F.count("*").alias("groups"), F.count_if(F.col("n") < least).alias("sparse"), F.percentile("n", F.lit(0.5)).alias("median"), (F.sum(F.when(F.col("r") <= top, F.col("n"))) / F.sum("n")).alias("top_share"))


def null_audit(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns])


def multiplicity(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(n, groups): how many groups have n distinct values."""
    each = rows.groupBy(*group).agg(F.countDistinct(value).alias("n"))
    return each.groupBy("n").agg(F.count("*").alias("groups"))


def ordinal(rows: DataFrame, column: str, name: str, ids: DataFrame | None = None, unknown: str = "error") -> DataFrame:
    """``rows`` with the 0-based rank of the column's value among the sorted distinct ones.

    ``ids`` is a dictionary (column, name) fitted before, by ``ranks.dictionary``; without it that of ``rows``. Values that
    it lacks, null among them, raise in the task that meets them ('error'), get -1 ('keep'), or go with their rows
    ('skip'). All rows are kept otherwise; a dictionary fitted here numbers values in ranges, so no task holds them all.
    """
    if unknown not in ("error", "keep", "skip"):
        raise ValueError(f"unknown={unknown!r}: error, keep or skip")
    fitted = ids is None
    ids = dictionary(rows, column, name) if fitted else ids.select(column, name)
    found = rows.join(ids, column, "inner" if unknown == "skip" else "left")
    if unknown == "skip":
        return found.select(*rows.columns, name)
    missing = F.raise_error(F.concat(F.lit(f"{column}: unknown value "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    instead = F.lit(-1) if unknown == "keep" else missing.cast("bigint")
    instead = F.when(F.col(column).isNull(), F.lit(None).cast("bigint")).otherwise(instead) if fitted else instead
    return found.select(*rows.columns, F.coalesce(F.col(name), instead).alias(name))


def standardised(rows: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation, both from ``fit``; a zero deviation counts as 1."""
    fit = rows if fit is None else fit
    stats = fit.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = rows.join(F.broadcast(stats))  # one row
    return joined.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}).drop(*stats.columns)


def class_distribution(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, n, positives, pct): sizes, positives and share of all rows."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row a group


def extents(rows: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """First and last position and number of rows of each group."""
    return rows.groupBy(*by).agg(F.min(pos).alias("start"), F.max(pos).alias("stop"), F.count("*").alias("n"))


def max_with_fallback(rows: DataFrame, group: str, value: str, primary: Column, default: int, least: int = 100) -> DataFrame:
    """(group, value): the greatest primary value, else the greatest of all, else ``default``; never under ``least``."""
    best = F.coalesce(F.max(F.when(primary, F.col(value))), F.max(value), F.lit(default))
    return rows.groupBy(group).agg(F.greatest(best, F.lit(least)).alias(value))


def imbalance_weight(rows: DataFrame, label: str) -> DataFrame:
    """(weight): negatives over positives, null without positives."""
    counts = rows.agg(F.count_if(F.col(label) == 0).alias("q"), F.count_if(F.col(label) == 1).alias("p"))
    return counts.select(F.expr("try_divide(q, p)").alias("weight"))


def off_primary(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, kinds, off): distinct values and rows off the most frequent one, of groups with several values."""
    primary = mode_by(rows, group, value, order).select(group, F.col(value).alias("_p"))
    found = rows.join(primary, group).groupBy(group).agg(F.countDistinct(value).alias("kinds"), F.count_if(F.col(value) != F.col("_p")).alias("off"))
    return found.where("kinds > 1")


def primary_flag(rows: DataFrame, group: str, value: str, order: str, name: str) -> DataFrame:
    """``rows`` with 1 where their value is the group's most frequent one; an empty value is never it."""
    told = rows.where(F.coalesce(F.col(value), F.lit("")) != "")
    primary = mode_by(told, group, value, order).select(F.col(group).alias("_g"), F.col(value).alias("_p"))
    return rows.join(primary, F.col(group) == F.col("_g"), "left").withColumn(name, F.coalesce(F.col(value) == F.col("_p"), F.lit(False)).cast("int")).drop("_g", "_p")


def class_counts(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, classes): a map of each class to its number of rows, classes in order of their names."""
    each = rows.where(F.col(kind).isNotNull()).groupBy(group, kind).agg(F.count("*").alias("n"))
    return each.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n")))).alias("classes"))


def panel_rollup(derived: DataFrame, known: DataFrame, group: str, value: str) -> DataFrame:
    """(groups, plus, minus, other, agreeing, agreement_pct) of a panel's derived values against a known list.

    Groups that are not derived count as disagreeing.
    """
    both = known.select(group, F.col(value).alias("_k")).join(derived.select(group, F.col(value).alias("_d")), group, "left")
    v = F.col("_d")
    counts = both.agg(F.count("*").alias("groups"), F.count_if(v == "+").alias("plus"), F.count_if(v == "-").alias("minus"), F.count_if(~F.coalesce(v.isin("+", "-"), F.lit(False))).alias("other"), F.count_if(F.coalesce(v == F.col("_k"), F.lit(False))).alias("agreeing"))
    return counts.withColumn("agreement_pct", F.expr("try_divide(100.0 * agreeing, groups)").cast("double"))


def status_summary(rows: DataFrame, status: str = "residue_status") -> DataFrame:
    """(total, matched, mismatched, out_of_bounds, missing, stop_site, rate) of residue checks; stop sites aren't asked."""
    names = {"matched": "matched", "mismatched": "mismatch", "out_of_bounds": "out_of_bounds", "missing": "missing", "stop_site": "stop_site"}
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(n) for n, v in names.items()])
    return counts.withColumn("rate", F.expr("try_divide(matched, total - stop_site)"))


def changed_classes(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """(before, after, n) of keys whose value differs between two snapshots."""
    both = old.select(*key, F.col(value).alias("before")).join(new.select(*key, F.col(value).alias("after")), key)
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).groupBy("before", "after").agg(F.count("*").alias("n"))


def largest_groups(rows: DataFrame, group: str, top: int = 8) -> DataFrame:
    """(group, n) of the ``top`` largest groups, ties by name: a report's list."""
    return rows.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(top)


def first_mismatches(rows: DataFrame, order: list[str], status: str = "residue_status", top: int = 10) -> DataFrame:
    """The first ``top`` rows whose residue differs, as examples for a report."""
    return rows.where(F.col(status) == "mismatch").orderBy(*order).limit(top)


def in_vocabulary_order(rows: DataFrame, kind: str = "variant_class") -> DataFrame:
    """``rows`` (one a class) with ``class_id`` and in its order; classes outside the vocabulary come with other_noncoding."""
    from locusframe.functions.hgvs import class_id

    return rows.withColumn("class_id", class_id(F.col(kind))).orderBy("class_id", kind)


def coordinate_breaks(rows: DataFrame, by: list[str], strand: str, cpos: str, pos: str = "pos") -> DataFrame:
    """(by, breaks): how often the coding position runs against the genome's along a strand ('-' turns the order)."""
    before = lambda c: F.lag(c).over(Window.partitionBy(*by).orderBy(cpos, pos))
    sign = F.when(F.col(strand) == "-", -1).otherwise(1)
    against = (F.col(cpos) > before(cpos)) & (sign * (F.col(pos) - before(pos)) < 0)
    return rows.select(*by, against.alias("_against")).groupBy(*by).agg(F.count_if("_against").alias("breaks"))


def snapshot_agreement(old: DataFrame, new: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """(shared, only_old, only_new, <column>_same, ...) of two tables with one row a key."""
    a = old.select(*key, F.struct(*compared).alias("_a"))
    b = new.select(*key, F.struct(*compared).alias("_b"))
    both = a.join(b, key, "full")
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    same = [F.count_if(in_a & in_b & F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(f"{c}_same") for c in compared]
    return both.agg(F.count_if(in_a & in_b).alias("shared"), F.count_if(in_a & ~in_b).alias("only_old"), F.count_if(~in_a & in_b).alias("only_new"), *same)


def order_breaks(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, breaks): how often ``value`` falls from one row to the next in ``order``."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return rows.select(*by, (F.col(value) < before).alias("_down")).groupBy(*by).agg(F.count_if("_down").alias("breaks"))
