"""Operator 8: SimHash near-duplicates, candidates found and pruned by the pigeonring principle.

A fingerprint's 64 bits are cut into SEGMENTS segments that form a ring. If two fingerprints differ in at most t bits,
some segment starts a chain round the ring whose first l segments differ in at most l * t / SEGMENTS bits together, for
every l (the pigeonring principle). With 5 segments and t = 4 such a chain begins with an equal segment and then a
segment that differs in one bit at most: that is the join key. The longer chains prune what the key lets through, and the
chain of all five is the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import broadcast_if_small, text_batches, text_code, without, written
from locusframe.llm.components import connected_components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z only
SEGMENTS = 5
WIDTHS = (13, 13, 13, 13, 12)
OFFSETS = (0, 13, 26, 39, 52)
#: Rows of a bucket compared by one task at once; a larger bucket is dealt out in pairs of blocks.
BLOCK_ROWS = 4096


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """The SimHash of one UTF-8 text: a bit is set if it is set in over half of the shingles' XXH64; no words: 0."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 65536):  # memory doesn't grow with the text
        some = found[at : at + 65536 + words - 1]
        grams = map(b" ".join, zip(*[some[k:] for k in range(words)], strict=False)) if n > 1 else [b" ".join(found)]
        hashes = np.array([digest(g, seed) for g in grams], dtype=np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed long; one pass, no shuffle."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, 1):
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["key", "fp"])

    return source.mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, OFFSETS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def bucket_rows(fps: DataFrame) -> DataFrame:
    """(bucket, fp, own): each fingerprint in its own bucket of each chain start, and in those of its variants.

    A bucket is (start, segment, next segment). Of two fingerprints whose next segments differ in one bit, the one
    without that bit goes to the other's bucket: about 7 rows a chain start, each pair meets once.
    """
    entries = []
    for i in range(SEGMENTS):
        j = (i + 1) % SEGMENTS
        head = F.lit(i).cast("long").bitwiseOR(F.shiftleft(_segment(F.col("fp"), i), 3))
        following = _segment(F.col("fp"), j)
        bucket = lambda seg, head=head: head.bitwiseOR(F.shiftleft(seg, 16))
        entries.append(F.struct(bucket(following).alias("bucket"), F.lit(True).alias("own")))
        for bit in range(WIDTHS[j]):
            mask = F.lit(1 << bit).cast("long")
            entries.append(F.when(following.bitwiseAND(mask) == 0, F.struct(bucket(following.bitwiseOR(mask)).alias("bucket"), F.lit(False).alias("own"))))
    rows = fps.select("fp", F.explode(F.array(*entries)).alias("e")).where("e is not null")
    return rows.select(F.col("e.bucket").alias("bucket"), "fp", F.col("e.own").alias("own"))


def chain_links(start: int, own: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    """Which pairs (row: own, column: other) keep the budgets of all chains from ``start``, the full distance last."""
    differing = own[:, None] ^ other[None, :]
    total = np.zeros(differing.shape, dtype=np.uint8)
    keeps = np.ones(differing.shape, dtype=bool)
    for length in range(1, SEGMENTS + 1):
        i = (start + length - 1) % SEGMENTS
        total += np.bitwise_count(differing & np.uint64(((1 << WIDTHS[i]) - 1) << OFFSETS[i]))
        keeps &= total <= length * most // SEGMENTS
    return keeps


def _forest(own: np.ndarray, rest: np.ndarray, start: int, most: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs own-own and own-rest connect, fewer than there are fingerprints."""
    every = np.concatenate([own, rest])
    if len(every) == 2:
        return [(0, 1)] if chain_links(start, every[:1], every[1:], most)[0, 0] else []
    group = np.arange(len(every))
    links = []
    for at in range(0, len(own), 256):
        some = chain_links(start, own[at : at + 256], every, most)
        for row, near in enumerate(some, at):
            others = np.flatnonzero(near & (group != group[row]))
            if len(others):
                _, firsts = np.unique(group[others], return_index=True)
                for k in others[firsts]:
                    links.append((row, int(k)))
                group[np.isin(group, group[others])] = group[row]
    return links


def near_links(fps: DataFrame, most: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs with at most ``most`` (4 or less) differing bits.

    Buckets with one row are dropped by a count that is summed before the shuffle. What is left is compared inside
    tasks, which return a spanning forest of each bucket instead of its pairs; a bucket of over ``block_rows`` rows is
    dealt out as pairs of blocks, so no task holds it. No pair within the distance is left unconnected.
    """
    if most > 4:
        raise ValueError("the key holds for at most 4 differing bits")
    rows = bucket_rows(fps)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).where("n > 1 and owners > 0")
    sizes = written(sizes.select("bucket", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "buckets")
    held = rows.join(broadcast_if_small(sizes), "bucket").withColumn("at", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # own rows meet every block; all rows (own ones too) are what they meet
    asked = held.where("own").select("bucket", F.col("at").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), "fp", F.lit(True).alias("asks"))
    met = held.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.col("at").alias("y"), "fp", F.lit(False).alias("asks"))
    pairs = asked.unionByName(met).select(F.xxhash64("bucket", "x", "y").alias("part"), "bucket", "x", "y", "fp", "asks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[pa.RecordBatch] = []

        def done(data: pa.Table) -> pa.RecordBatch:
            bucket, x, y, fp, asks = (data.column(c).to_numpy() for c in ("bucket", "x", "y", "fp", "asks"))
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            left, right, fp = [], [], fp.view(np.uint64)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
                own = np.unique(fp[a:b][asks[a:b]])
                rest = np.setdiff1d(fp[a:b][~asks[a:b]], own)
                if len(own) and len(own) + len(rest) > 1:
                    every = np.concatenate([own, rest])
                    for i, j in _forest(own, rest, int(bucket[a]) & 7, most):
                        left.append(every[i])
                        right.append(every[j])
            return pa.RecordBatch.from_arrays([pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for v in (left, right)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            data = pa.Table.from_batches([*carried, batch])
            last = data.slice(data.num_rows - 1)
            same = np.ones(data.num_rows, dtype=bool)
            for c in ("bucket", "x", "y"):
                same &= data.column(c).to_numpy() == last.column(c)[0].as_py()
            start = int(np.argmax(same))  # sorted: the open group is the tail
            if start:
                yield done(data.slice(0, start))
            carried = data.slice(start).to_batches()
        if carried:
            yield done(pa.Table.from_batches(carried))

    dealt = pairs.repartition("part").sortWithinPartitions("bucket", "x", "y")
    return dealt.select("bucket", "x", "y", "fp", "asks").mapInArrow(compare, "a bigint, b bigint")


def _classes(distinct: DataFrame, most: int) -> DataFrame:
    """``distinct`` (a row a fingerprint) with ``class``, the same for all fingerprints that links connect."""
    linked = connected_components(near_links(distinct.select("fp"), most), "a", "b")
    return distinct.join(linked, distinct["fp"] == linked["node"], "left").withColumn("class", F.coalesce("component", "fp"))


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 4) -> DataFrame:
    """One row a document: key, fingerprint (16 hex digits) and component_id, the least key it is linked with.

    Documents link if their fingerprints differ in at most ``most`` bits. Equal fingerprints are one row before any
    comparison, so copies cost nothing. Null and empty texts have the fingerprint zero and link like any other; null
    keys are linked too but never name a component unless it has no other; repeated rows pass through.
    """
    prints = written(fingerprints(docs, key, text), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    classes = _classes(distinct, most)
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classes.select("fp", "class").join(least, "class").select("fp", "component_id")
    return prints.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 4) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that with the least key; all columns kept.

    A document is its key and its text's hash, so other texts under the same key (null too, which comes last) stay. Rows
    that repeat the one that stays are rare: they are looked at only if there are any.
    """
    named = docs.select(F.struct(F.col(key).alias("key"), text_code(F.col(text)).alias("code")).alias("who"), F.col(text).alias("text"))
    prints = written(fingerprints(named, "who", "text").select("who.key", "who.code", "fp"), "fingerprints")
    place = F.struct(F.col("key").isNull().alias("last"), "key", "fp", "code")
    distinct = written(prints.groupBy("fp").agg(F.min(place).alias("least")), "distinct")
    classes = _classes(distinct, most)
    firsts = classes.groupBy("class").agg(F.min("least").alias("first"))
    marked = prints.join(classes.select("fp", "class").join(firsts, "class").select("fp", "first"), "fp")
    stays = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("fp") == F.col("first.fp")) & (F.col("code") == F.col("first.code"))
    told = marked.groupBy(F.col("key").alias("_lf_key"), F.col("code").alias("_lf_code")).agg(F.first(stays).alias("stays"), F.count("*").alias("n"))
    return without(docs, written(told.where("not stays or n > 1"), "gone"), key, text)
