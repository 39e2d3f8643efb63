"""Operator 7 for instruction data: whole conversations as items with three demands.

An item is a conversation, or a run of its turns where it exceeds a limit: its tokens, its segments and its answers'
tokens are what a sequence has to have room for. So prompts stand before their answers in one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import written
from locusframe.llm.packing import Limits, pack_block, token_pieces

_SUMS = ("length", "one", "loss")


def _running(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with the sums of length, one and loss before each in its group, in ``order``.

    Rows are sorted in ranges, so a group of any size is many tasks; what a range has of a group is one row, and these are
    summed up over the group's ranges.
    """
    keys = [group, *order]
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, dict.fromkeys(_SUMS, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pd.Series(batch.column(group).to_pylist(), dtype=object)
            codes = (own != own.shift()).to_numpy()
            codes[0] = last is None or own.iloc[0] != last
            run = np.cumsum(codes)  # 0: the group that the last batch ended with
            out = []
            for c in _SUMS:
                value = batch.column(c).to_numpy(zero_copy_only=False)
                total = np.cumsum(value)
                base = np.concatenate([[-carry[c]], (total - value)[codes]])[run]
                out.append(total - value - base)
                carry[c] = int(total[-1] - base[-1])
            last = own.iloc[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out), pa.array(np.full(batch.num_rows, part))], [*names, *[f"before_{c}" for c in _SUMS], "part"])

    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = written(ranged.mapInArrow(walk, f"{kinds}, {', '.join(f'before_{c} bigint' for c in _SUMS)}, part bigint"), "running")
    totals = local.groupBy(group, "part").agg(*[F.sum(c).alias(f"_t_{c}") for c in _SUMS])
    across = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select(group, "part", *[F.coalesce(F.sum(f"_t_{c}").over(across), F.lit(0)).alias(f"_f_{c}") for c in _SUMS])
    joined = local.join(first, [group, "part"])
    return joined.select(*names, *[(F.col(f"before_{c}") + F.col(f"_f_{c}")).alias(f"before_{c}") for c in _SUMS])


def _packed_items(items: DataFrame, limits: Limits, block_rows: int) -> DataFrame:
    """(item, sequence_id, item_offset): items packed in hash blocks by ``pack_block``; sequence numbers are gapless."""
    blocks = max(1, -(-items.count() // block_rows))
    most = np.array([limits.tokens, limits.segments, limits.loss])

    def one(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("item", kind="stable").reset_index(drop=True)
        block["bin"], block["place"] = pack_block(block[list(_SUMS)].to_numpy(np.int64), most)
        block = block.sort_values(["bin", "place"], kind="stable")
        block["item_offset"] = block.groupby("bin")["length"].cumsum() - block["length"]
        return block[["item", "block", "bin", "item_offset"]]

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    placed = written(dealt.groupBy("block").applyInPandas(one, "item string, block bigint, bin bigint, item_offset bigint"), "placed")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    first = placed.groupBy("block").agg((F.max("bin") + 1).alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return placed.join(first, "block").select("item", (F.col("first") + F.col("bin")).alias("sequence_id"), "item_offset")


def pack_conversations(turns: DataFrame, vocabulary: str, end: int, limits: Limits = Limits(), conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", answer: str = "assistant", block_rows: int = 2048) -> DataFrame:
    """Conversations packed whole: conversation, turn, role, start, length, ids_crc32, loss, item, sequence_id, offset, a row a segment.

    Turns are tokenised with ``end`` after each; a turn longer than half a sequence (or half its loss) is cut in pieces of
    at most that. A conversation within all limits is one item: its segments stand in one sequence, in order of turn (null
    first; equal turns by role, then by their ids), with no gap. Of a larger one, runs of turns are items: a run ends where
    half of a limit is passed, so it fits by itself. ``loss`` is the length of the ``answer`` role's segments, 0 of others.
    Null and empty texts have the end id only; a null conversation is a conversation, null roles aren't answers; repeated
    turns are packed each; an empty table gives none; other columns are ignored, whatever their names.
    """
    if min(limits.tokens, limits.segments, limits.loss) < 2:
        raise ValueError("limits of 2 at least")
    told = F.to_json(F.struct(F.col(conversation).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r")))
    cut = token_pieces(turns.select(told.alias("segment"), F.col(text).alias("text")), vocabulary, end, min(limits.tokens, limits.loss) // 2, "segment")
    kinds = ", ".join(f"{n} {turns.schema[c].dataType.simpleString()}" for n, c in (("c", conversation), ("t", turn), ("r", role)))
    read = cut.withColumn("s", F.from_json("segment", kinds))
    answers = F.coalesce(F.col("s.r") == answer, F.lit(False))
    pieces = read.select(
        F.coalesce(F.to_json(F.struct("s.c")), F.lit("{}")).alias("conv"), F.col("s.c").alias("c"), F.col("s.t").alias("t"), F.col("s.r").alias("r"), "start", "length", "ids_crc32", "doc_tokens",
        F.lit(1).cast("bigint").alias("one"), F.when(answers, F.col("length")).otherwise(0).cast("bigint").alias("loss"),
    )
    # a cut turn's pieces stand together: repeated turns of one text are told by nothing but their pieces
    placed = written(_running(pieces, "conv", ["t", "r", "doc_tokens", "start", "ids_crc32"]), "pieces")
    whole = placed.groupBy("conv").agg(*[F.sum(c).alias(f"all_{c}") for c in _SUMS])
    fits = (F.col("all_length") <= limits.tokens) & (F.col("all_one") <= limits.segments) & (F.col("all_loss") <= limits.loss)
    halves = {"length": limits.tokens // 2, "one": limits.segments // 2, "loss": limits.loss // 2}
    run = F.concat_ws("-", *[F.floor(F.col(f"before_{c}") / n).cast("string") for c, n in halves.items()])
    marked = written(placed.join(whole, "conv").withColumn("item", F.concat("conv", F.when(fits, "").otherwise(F.concat(F.lit("#"), run)))), "marked")
    items = written(marked.groupBy("item").agg(*[F.sum(c).alias(c) for c in _SUMS], F.min("before_length").alias("item_start")), "items")
    found = items.select("item", "item_start").join(_packed_items(items.drop("item_start"), limits, block_rows), "item")
    offset = F.col("item_offset") + F.col("before_length") - F.col("item_start")
    return marked.join(found, "item").select(F.col("c").alias(conversation), F.col("t").alias(turn), F.col("r").alias(role), "start", "length", "ids_crc32", "loss", "item", "sequence_id", offset.alias("offset"))
