"""Train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators.ranks import numbered, positions
from locusframe.sources.shared import written


def stratified_split(rows: DataFrame, label: str, order: Column, key: str, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """``split`` with exact shares inside each label; the numeric ``order`` (a seeded hash, or a key), then ``key``, decides who goes where."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_all"))
    return _cut(numbered(rows, [label], order, [key]).join(F.broadcast(sizes), label), train, validation)  # a row a label


def time_split(rows: DataFrame, time: Column, key: str, train: float = 0.70, validation: float = 0.10) -> DataFrame:
    """``split`` by time, oldest first; times that can't be read are oldest."""
    at = F.coalesce(time, F.lit("1970-01-01").cast("timestamp"))
    # sorted in ranges of time and key, so a day that holds most rows (all times that can't be read) is many ranges
    ranked = positions(rows, [], [at, F.col(key)])
    return _cut(ranked.join(F.broadcast(rows.agg(F.count("*").alias("_all")))), train, validation)  # one row


def _cut(ranked: DataFrame, train: float, validation: float) -> DataFrame:
    split = F.when(F.col("_n") <= F.floor(F.col("_all") * train + 1e-9), "train").when(F.col("_n") <= F.floor(F.col("_all") * (train + validation) + 1e-9), "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("_n", "_all")


def group_folds(rows: DataFrame, group: str, folds: int = 5, share: int = 1000, blocks: int = 1024) -> DataFrame:
    """``fold`` of each row's group, balanced by rows: heaviest first into the lightest fold.

    Groups of over 1 / ``share`` of all rows (so at most ``share``) are dealt one by one, the small rest by hash block, so
    what is dealt on the driver is at most ``share`` + ``blocks`` entries however many groups there are.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64(F.lit(17), F.col(group)), F.lit(blocks)).cast("int")
    total = rows.count()
    heavy = sizes.where(F.col("n") * share > total).select(F.col(group).alias("_group"), F.lit(None).cast("int").alias("_block"), "n")
    rest = sizes.where(F.col("n") * share <= total).groupBy(block.alias("_block")).agg(F.sum("n").alias("n")).select(F.lit(None).cast(rows.schema[group].dataType).alias("_group"), "_block", "n")
    loads, dealt = [0] * folds, []
    for r in heavy.unionByName(rest).orderBy(F.desc("n"), "_block", "_group").collect():
        fold = loads.index(min(loads))
        loads[fold] += r["n"]
        dealt.append((r["_group"], r["_block"], fold))
    kind = rows.schema[group].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(dealt, f"_group {kind}, _block int, _fold int")
    by_group = table.where("_block is null").select("_group", "_fold")
    by_block = table.where("_block is not null").select("_block", F.col("_fold").alias("_rest"))
    found = rows.withColumn("_block", block).join(F.broadcast(by_group), F.col(group).eqNullSafe(F.col("_group")), "left").join(F.broadcast(by_block), "_block", "left")
    return found.withColumn("fold", F.coalesce("_fold", "_rest")).drop("_group", "_block", "_fold", "_rest")


def deal_groups(sizes: DataFrame, group: str, folds: int, share: int = 1000, blocks: int = 1024) -> DataFrame:
    """``sizes`` (group, n) with ``fold``: as ``group_folds`` deals groups, from their counted sizes."""
    block = F.pmod(F.xxhash64(F.lit(17), F.col(group)), F.lit(blocks)).cast("int")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    heavy = sizes.where(F.col("n") * share > total).select(F.col(group).alias("_group"), F.lit(None).cast("int").alias("_block"), "n")
    rest = sizes.where(F.col("n") * share <= total).groupBy(block.alias("_block")).agg(F.sum("n").alias("n")).select(F.lit(None).cast(sizes.schema[group].dataType).alias("_group"), "_block", "n")
    loads, dealt = [0] * folds, []
    for r in heavy.unionByName(rest).orderBy(F.desc("n"), "_block", "_group").collect():  # share + blocks rows at most
        fold = loads.index(min(loads))
        loads[fold] += r["n"]
        dealt.append((r["_group"], r["_block"], fold))
    table = sizes.sparkSession.createDataFrame(dealt, f"_group {sizes.schema[group].dataType.simpleString()}, _block int, _fold int")
    by_group, by_block = table.where("_block is null").select("_group", "_fold"), table.where("_block is not null").select("_block", F.col("_fold").alias("_rest"))
    found = sizes.withColumn("_block", block).join(F.broadcast(by_group), F.col(group).eqNullSafe(F.col("_group")), "left").join(F.broadcast(by_block), "_block", "left")
    return found.withColumn("fold", F.coalesce("_fold", "_rest")).select(*sizes.columns, "fold")


def nested_folds(rows: DataFrame, group: str, folds: int = 5, inner: int = 6) -> DataFrame:
    """``rows`` with ``roles``: in each of ``folds`` rounds 'test', 'validation' or 'train', a group on one side of each round.

    Round k tests fold k of the groups; its other groups are dealt into ``inner`` folds of which the first is for
    validation. Rows are counted once and tagged once; all dealing is on the groups' sizes. A null group is a group.
    """
    sizes = written(rows.groupBy(group).agg(F.count("*").alias("n")), "sizes")
    outer = written(deal_groups(sizes, group, folds), "outer")
    roles = outer.select(F.col(group).alias("_g"), *[F.when(F.col("fold") == k, "test").alias(f"_r{k}") for k in range(folds)])
    for k in range(folds):
        held = deal_groups(outer.where(F.col("fold") != k).select(group, "n"), group, inner).where("fold = 0").select(F.col(group).alias(f"_v{k}"), F.lit("validation").alias(f"_n{k}"))
        roles = roles.join(held, F.col("_g").eqNullSafe(F.col(f"_v{k}")), "left").withColumn(f"_r{k}", F.coalesce(f"_r{k}", f"_n{k}", F.lit("train"))).drop(f"_v{k}", f"_n{k}")
    roles = written(roles.select("_g", F.array(*[f"_r{k}" for k in range(folds)]).alias("roles")), "roles")
    return rows.join(roles, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def group_transfer(rows: DataFrame, group: str, train: list[str], test: list[str]) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows of two disjoint sets of groups."""
    if both := set(train) & set(test):
        raise ValueError("groups on both sides: " + ", ".join(sorted(map(str, both))))
    return rows.where(F.col(group).isin(train)), rows.where(F.col(group).isin(test))


def position_block(aa_pos: Column, pos: Column) -> Column:
    """Windows of 25 residues, or of 5 kb where there is no residue."""
    return F.when(aa_pos > 0, F.concat(F.lit("a"), F.floor(aa_pos / 25))).otherwise(F.concat(F.lit("g"), F.floor(pos / 5000)))


def neighbour_leak(train: DataFrame, test: DataFrame, key: list[str]) -> DataFrame:
    """(rows, shared): how many test rows have a key that training rows have too."""
    known = train.select(*key).distinct().withColumn("_k", F.lit(1))
    return test.join(known, key, "left").agg(F.count("*").alias("rows"), F.count("_k").alias("shared"))


def neighbour_mean(train: DataFrame, test: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """``test`` rows whose key training rows have too, with the training mean of that key: what leaks through neighbours."""
    means = train.groupBy(*key).agg(F.avg(label).alias("neighbour_mean"))
    return test.join(means, key)
