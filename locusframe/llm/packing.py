"""Operator 7: vector bin packing of tokenised examples by the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import text_slices, written
from locusframe.llm.token_cache import text_encoder


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most: tokens, segments (pieces), and tokens that bear loss."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


def pack_block(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in it) of every item of one block; ``sizes`` has a row an item and a column a resource.

    Bins are filled one after the other. Into the open bin goes, of the items that still fit in every resource, the one
    with the largest dot product of its demand with the bin's remaining room, both as shares of the limits and each
    resource weighted by the block's whole demand for it (scarce ones count more). Ties go to the first item. Every
    item must fit an empty bin.
    """
    shares = sizes / limits
    weights = shares.mean(axis=0) if len(sizes) else shares.sum(axis=0)
    left = np.arange(len(sizes))
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    current = count = 0
    room = limits.astype(np.int64).copy()
    while len(left):
        fits = left[(sizes[left] <= room).all(axis=1)]
        if not len(fits):
            if not count:
                raise ValueError("an item is larger than a sequence")
            current, count, room = current + 1, 0, limits.astype(np.int64).copy()
            continue
        best = fits[np.argmax(shares[fits] @ (weights * room / limits))]
        bins[best], places[best] = current, count
        count += 1
        room -= sizes[best]
        left = left[left != best]
    return bins, places


def pack(pieces: DataFrame, limits: Limits, key: str, length: str, loss: Column, block_rows: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset (tokens before the piece in its sequence, without gaps from 0).

    Rows are dealt to blocks of about ``block_rows`` by a hash of all their columns, so that pieces under one key (null
    too) spread; only equal rows share a block. Each block is packed on its own in one task, so that memory and time a
    task don't grow with the table, and a block wastes one partly filled sequence at most. Sequence numbers are made
    gapless by the blocks' counts. No piece may exceed a limit by itself. Repeated rows are packed each.
    """
    blocks = max(1, -(-pieces.count() // block_rows))
    rows = pieces.withColumn("_lf_block", F.pmod(F.xxhash64(*[c for c, t in pieces.dtypes if not t.startswith(("array", "map"))]), F.lit(blocks))).withColumn("_lf_loss", loss.cast("long"))
    most = np.array([limits.tokens, limits.segments, limits.loss])
    names = pieces.columns

    def one(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values([c for c in (key, "start", "ids_crc32") if c in block], kind="stable").reset_index(drop=True)
        sizes = np.stack([block[length].to_numpy(np.int64), np.ones(len(block), np.int64), block["_lf_loss"].to_numpy(np.int64)], axis=1)
        full = (sizes[:, 0] == limits.tokens) | (sizes[:, 2] == limits.loss)
        bins, places = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        bins[full] = np.arange(full.sum())
        if (~full).any():
            bins[~full], places[~full] = pack_block(sizes[~full], most)
            bins[~full] += full.sum()
        block["_lf_bin"], block["_lf_place"] = bins, places
        block = block.sort_values(["_lf_bin", "_lf_place"], kind="stable")
        block["offset"] = block.groupby("_lf_bin")[length].cumsum() - block[length]
        return block[[*names, "_lf_block", "_lf_bin", "offset"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    placed = written(rows.groupBy("_lf_block").applyInPandas(one, f"{kinds}, _lf_block bigint, _lf_bin bigint, offset bigint"), "packed")
    before = Window.orderBy("_lf_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    first = placed.groupBy("_lf_block").agg((F.max("_lf_bin") + 1).alias("n")).select("_lf_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_lf_first"))
    return placed.join(first, "_lf_block").withColumn("sequence_id", F.col("_lf_first") + F.col("_lf_bin")).select(*names, "sequence_id", "offset")


def token_pieces(docs: DataFrame, vocabulary: str, end: int, longest: int, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Every text's ids (then ``end``) cut into pieces of at most ``longest``: key, start, length, ids_crc32, doc_tokens.

    Null and empty texts are one piece with the end id. ``ids`` adds the piece's ids as an array.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            found, at = text_encoder(vocabulary).encode_all(batch.column(1))
            rows: list[tuple] = []
            for name, a, b in zip(batch.column(0).to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                own, total = np.append(found[a:b], np.uint32(end)), b - a + 1
                for start in range(0, total, longest):
                    piece = own[start : start + longest]
                    rows.append((name, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), total, *([piece.astype(np.int64)] if ids else [])))
            columns = list(zip(*rows, strict=True))
            types = [batch.column(0).type, *[pa.int64()] * 4, *([pa.list_(pa.int64())] if ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(types)])

    more = ", ids array<bigint>" if ids else ""
    return source.mapInArrow(cut, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint{more}").withColumnRenamed("key", key)


def pack_documents(docs: DataFrame, vocabulary: str, end: int, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs whole documents; each id lies in one piece, all of its tokens bear loss.

    Returns key, start, length, ids_crc32, doc_tokens, sequence_id, offset and (``ids``) ids. Null and empty texts are one
    piece with the end id; null keys and repeated rows are packed each; an empty table gives none; other columns are
    ignored, whatever their names.
    """
    pieces = written(token_pieces(docs, vocabulary, end, min(limits.tokens, limits.loss), key, text, ids), "pieces")
    return pack(pieces, limits, key, "length", F.col("length"))
