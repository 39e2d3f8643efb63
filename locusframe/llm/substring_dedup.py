"""Operator 3: near-duplicate passages inside documents, by MinHash banding of paragraphs.

A paragraph is cut from the text by its own content: at line ends, and after a sentence of SENTENCE words or more (short
sentences go with what follows). So a passage that is pasted into another context is cut there as it is cut at home,
whatever stands before it, and all but its edges meets its copies.

Paragraphs of distinct text are banded: BANDS keys of ROWS minima each over their five-word shingles. At the similarity
0.8 a pair shares a key with probability 1 - (1 - 0.8^2)^5 = 0.994. Pairs that share a key are verified by their exact
Jaccard similarity; components of what is left are the classes.

Passages that no mark or line end cuts are found by their words alone: every window of LEAST_RUN words belongs to the
least of its GRAM-word hashes, so equal windows have equal anchors wherever they stand. Windows are looked at one by one
only where anchors repeat and their surroundings differ; no repeated window is lost.

Texts are dealt out once, into a bucketed table; each later look at some of them (shingle sets, windows, cuts) joins it
without an exchange. Paragraphs, anchors and windows cross the network once each, and those that stand alone are left
where they meet. No step changes its way with the size of the table, so that disk grows as the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import broadcast_if_small, dropped, shared_path, text_batches, written
from locusframe.llm.components import connected_components

SHINGLE = 5
BANDS, ROWS = 5, 2
#: Paragraphs of this Jaccard similarity or more are linked.
LEAST = 0.8
SENTENCE = 8
#: A run of paragraphs that repeat goes if it has this many words together; shorter ones are everyday phrases.
LEAST_WORDS = 30
BLOCK_ROWS = 2048
#: Each repeat of so many words in a row goes, however it is punctuated ("over 50 words").
LEAST_RUN = 51
GRAM = 16
#: A side of a join is broadcast up to so many rows (a few MB); larger ones are sorted.
SMALL = 50_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LOWER_CASE = np.frombuffer(_LOWER, np.uint8)
_SPACES, _MARKS = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\v\f\r", b".!?"))
#: Fixed values of XXH64, and the length from which it takes another way.
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
_LONG = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (shifts and odd multipliers; fixed values)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _xxh64(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The XXH64 (seed 0) of the ``length`` bytes, fewer than _LONG, from each place of ``at`` on."""
    p1, p2, p3, p4, p5 = _PRIMES
    turned = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    byte = lambda i: data[at + i].astype(np.uint64)
    read = lambda i, n: reduce(np.bitwise_or, (byte(i + k) << np.uint64(8 * k) for k in range(n)))
    h, done = np.full(len(at), p5 + np.uint64(length)), 0
    while length - done >= 8:
        h = turned(h ^ turned(read(done, 8) * p2, 31) * p1, 27) * p1 + p4
        done += 8
    if length - done >= 4:
        h = turned(h ^ read(done, 4) * p1, 23) * p2 + p3
        done += 4
    for i in range(done, length):
        h = turned(h ^ byte(i) * p5, 11) * p1
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


class Words:
    """The words of a few texts as arrays, A-Z as a-z: ``starts`` (bytes from the first text on, each text one line more), ``first`` (of each text), ``ends``.

    ``ends`` tells which words end a sentence. Words are found and hashed by array, all of one length at once; no Python object
    is made of a word but of the few of _LONG bytes or more.
    """

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        self._data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        space = _SPACES[self._data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, stops = edges[::2], edges[1::2]
        self._lengths = stops - self.starts
        self.n = len(self.starts)
        self.ends = _MARKS[self._data[stops - 1]]
        self.text_starts = np.cumsum([1, *[len(t) + 1 for t in texts]])[:-1]
        self.first = np.searchsorted(self.starts, self.text_starts)

    def codes(self) -> np.ndarray:
        """The XXH64 of each word, with the lowest bit set where it ends a sentence."""
        data = _LOWER_CASE[self._data]
        codes = np.zeros(self.n, np.uint64)
        order = np.argsort(np.minimum(self._lengths, _LONG).astype(np.uint8), kind="stable")
        stops = np.cumsum(np.bincount(np.minimum(self._lengths, _LONG), minlength=_LONG + 1)).tolist()
        for length in range(1, _LONG):
            own = order[stops[length - 1] : stops[length]]
            if len(own):
                codes[own] = _xxh64(data, self.starts[own], length)
        for i in order[stops[_LONG - 1] :].tolist():
            codes[i] = xxhash.xxh64_intdigest(data[self.starts[i] : self.starts[i] + self._lengths[i]])
        return codes & ~np.uint64(1) | self.ends

    def line_ends(self) -> np.ndarray:
        """The last word of each line that has one, in order."""
        before = np.searchsorted(self.starts, np.flatnonzero(self._data == 10))
        return np.unique(before[before > 0]) - 1


class Paragraphs:
    """The paragraphs of a few texts as arrays: ``doc`` (which text), ``number`` in it, first word and word count."""

    def __init__(self, texts: list[bytes | None], sentence: int = SENTENCE):
        self._words = words = Words(texts)
        self.n = words.n
        line_ends = words.line_ends()
        is_line = np.zeros(self.n, dtype=bool)
        is_line[line_ends] = True
        stop_at = np.flatnonzero(words.ends | is_line)
        cuts = stop_at[(np.diff(stop_at, prepend=-1) >= sentence) | is_line[stop_at]]
        self.starts = np.concatenate([[0], cuts[:-1] + 1]).astype(np.int64) if len(cuts) else np.zeros(0, np.int64)
        self.lengths = cuts + 1 - self.starts
        self.doc = np.searchsorted(words.first, cuts, side="right") - 1
        first = np.searchsorted(self.doc, self.doc)
        self.number = np.arange(len(cuts)) - first

    @cached_property
    def codes(self) -> np.ndarray:
        return self._words.codes()

    def names(self) -> np.ndarray:
        """A 64-bit hash of each paragraph's words in order, by which equal texts are known."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        place = np.arange(self.n, dtype=np.uint64) - np.repeat(self.starts, self.lengths).astype(np.uint64)
        return _mixed(np.add.reduceat(_mixed((self.codes >> np.uint64(1)) + (place + np.uint64(1)) * _ODD), self.starts) + self.lengths.astype(np.uint64))

    def shingles(self) -> np.ndarray:
        """The hash of the SHINGLE words from each place on (meaningful where they lie in one paragraph)."""
        hashes = np.zeros(self.n, dtype=np.uint64)
        count = max(0, self.n - SHINGLE + 1)
        for k in range(SHINGLE):
            hashes[:count] = _mixed(hashes[:count] + (self.codes[k : k + count] >> np.uint64(1)))
        return hashes

    def bands(self, chosen: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
        """The band keys (a row a band) of the chosen paragraphs, each of at least SHINGLE words."""
        hashes = self.shingles()
        counts = self.lengths[chosen] - SHINGLE + 1
        ends = np.cumsum(counts)
        flat = hashes[np.repeat(self.starts[chosen] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        keys = np.zeros((bands, len(chosen)), dtype=np.uint64)
        if len(chosen):
            for band in range(bands):
                for row in range(rows):
                    seed = np.uint64((band * rows + row + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                    keys[band] = _mixed(keys[band] + np.minimum.reduceat(_mixed(flat ^ seed), ends - counts) + np.uint64(band))
        return keys

    def sets(self, chosen: np.ndarray) -> list[np.ndarray]:
        """The distinct shingle hashes of the chosen paragraphs."""
        hashes = self.shingles()
        return [np.unique(hashes[self.starts[i] : self.starts[i] + self.lengths[i] - SHINGLE + 1]) for i in chosen.tolist()]


class Windows:
    """The windows of LEAST_RUN words of a few texts, in blocks: windows in a row that have the same anchor.

    ``doc`` (which text), ``start`` (first word in it), ``n`` windows, and hashes: ``anchor``, and ``block`` of all words
    from the first window's first to the last window's last.
    """

    def __init__(self, texts: list[bytes | None]):
        words = Words(texts)
        self.first, n = words.first, words.n
        self.hashes = np.zeros(0, np.uint64)
        self.doc = self.start = self.n = np.zeros(0, np.int64)
        self.anchor = self.block = np.zeros(0, np.uint64)
        if n < LEAST_RUN:
            return
        grams = _mixed(words.codes() >> np.uint64(1))
        width = 1
        while width < GRAM:
            grams = _mixed(grams[:-width] * _ODD + grams[width:])
            width *= 2
        count = n - LEAST_RUN + 1
        self.hashes = grams[:count]
        for at in (GRAM, 2 * GRAM, LEAST_RUN - GRAM):
            self.hashes = _mixed(self.hashes * _ODD + grams[at : at + count])
        # the first place of the least hash among the window's grams
        least, place, reach, width = grams, np.arange(len(grams)), LEAST_RUN - GRAM + 1, 1
        while width < reach:
            step = min(width, reach - width)
            less = least[step:] < least[:-step]
            least, place = np.where(less, least[step:], least[:-step]), np.where(less, place[step:], place[:-step])
            width += step
        doc = np.repeat(np.arange(len(texts)), np.diff(self.first, append=n))
        inside = np.flatnonzero(doc[:count] == doc[LEAST_RUN - 1 :])
        if not len(inside):
            return
        anchors = place[inside]
        begin = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        low, high, anchors = inside[begin], inside[np.append(begin[1:], len(inside)) - 1], anchors[begin]
        self.doc, self.n, self.anchor = doc[low], high - low + 1, grams[anchors]
        self.start = low - self.first[self.doc]
        self.block = _mixed(_mixed(self.hashes[low] * _ODD + self.hashes[high]) + (self.n << 6 | anchors - low).astype(np.uint64))

    def of(self, doc: int, start: int, n: int) -> np.ndarray:
        """The hashes of ``n`` windows of a text."""
        at = self.first[doc] + start
        return self.hashes[at : at + n]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def laid_out(docs: DataFrame, key: str, text: str, path: str) -> tuple[DataFrame, str]:
    """The rows of ``docs`` as a table bucketed by ``row``, a hash of key and text; and the key's type.

    Columns are key, text, th (the text's hash), row, and those of ``docs`` under the names c0, c1, ... Joins by ``row``
    move the other side only. Rows with one key and text share a ``row``; others do by a chance of n^2 / 2^65 of any
    mix-up. There are as many buckets as shuffle partitions. The table is in ``path`` and not in the catalog.
    """
    spark, names = docs.sparkSession, [f"c{i}" for i in range(len(docs.columns))]
    own = {c: n for c, n in zip(docs.columns, names, strict=True)}
    plain = docs.toDF(*names).withColumn("th", _text_hash(own[text])).withColumn("row", F.xxhash64(own[key], "th"))
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"spark_catalog.default.lf_texts_{uuid.uuid4().hex}"
    plain.repartition(buckets, "row").write.bucketBy(buckets, "row").option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay, and the plan has their layout
    return table.select("*", F.col(own[key]).alias("key"), F.col(own[text]).cast("string").alias("text")), docs.select(key).dtypes[0][1]


def _asking(source: DataFrame, asked: DataFrame, how: str = "inner") -> DataFrame:
    """The laid out texts with what is asked of their ``row``: the asking side is dealt to the buckets, texts aren't moved or sorted."""
    asked = asked.withColumnRenamed("row", "_row")
    return source.join(asked.hint("shuffle_hash"), source["row"] == asked["_row"], how).drop("_row")


def recurring(rows: DataFrame, by: str) -> DataFrame:
    """The rows whose ``by`` (a long) is on two rows or more; rows stream through their task, however many have one value."""
    at = rows.columns.index(by)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, again = None, False  # the last row, and whether it has the value of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            value = batch.column(at).to_numpy()
            same = np.concatenate([[again], value[1:] == value[:-1]])
            last = batch.num_rows - 1
            yield batch.slice(0, last).filter(pa.array(same[:-1] | same[1:]))
            held, again = batch.slice(last), same[last]
        if held is not None and again:
            yield held

    return rows.repartition(by).sortWithinPartitions(by).mapInArrow(keep, rows.schema)


def shared_bands(rows: DataFrame) -> DataFrame:
    """The distinct rows of (band, name) whose band has two names or more; rows stream through their task, whatever a band's size."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, and whether it was returned
        for batch in batches:
            if not batch.num_rows:
                continue
            band, name = (batch.column(i).to_numpy() for i in (0, 1))
            told = np.zeros(len(band), bool)
            if held is not None:
                band, name, told = (np.concatenate([[h], x]) for h, x in zip(held, (band, name, told), strict=True))
            new = np.concatenate([[True], (band[1:] != band[:-1]) | (name[1:] != name[:-1])])
            band, name, told = band[new], name[new], told[new]
            same = np.concatenate([[False], band[1:] == band[:-1], [False]])
            several = same[:-1] | same[1:]
            held = band[-1], name[-1], told[-1] | several[-1]
            out = several & ~told
            yield pa.RecordBatch.from_arrays([pa.array(band[out]), pa.array(name[out])], ["band", "name"])

    return rows.repartition("band").sortWithinPartitions("band", "name").mapInArrow(keep, "band bigint, name bigint")


def occurrences(source: DataFrame, kind: str) -> DataFrame:
    """(key, th, number, words, name, bands) of every paragraph of SHINGLE words or more, th telling texts under one key apart.

    ``name`` is the first half of its name, ``bands`` its band keys; of equal paragraphs in a slice of texts only the first has
    them, the others null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, 1):
            found = Paragraphs(texts)
            c = np.flatnonzero(found.lengths >= SHINGLE)
            names = found.names()[c]
            first = np.unique(names, return_index=True)[1]
            keys = np.ascontiguousarray(found.bands(c[first]).T)
            sizes = np.zeros(len(c) + 1, np.int32)
            sizes[first + 1] = BANDS
            order = np.argsort(first)
            missing = np.ones(len(c), bool)
            missing[first] = False
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), _signed(keys[order].ravel()), mask=pa.array(missing))
            own = pa.array(found.doc[c])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), pa.array(found.number[c].astype(np.int32)), pa.array(found.lengths[c].astype(np.int32)), _signed(names), bands], ["key", "th", "number", "words", "name", "bands"])

    return source.select("key", "text", "th").mapInArrow(run, f"key {kind}, th bigint, number int, words int, name bigint, bands array<bigint>")


def shingle_sets(source: DataFrame, places: DataFrame) -> DataFrame:
    """(name, shingles): the distinct shingle hashes of each marked paragraph of ``places``, read again from the first text that has it."""
    place = F.struct(F.col("key").isNull().alias("last"), "key", "th")
    least = places.groupBy("name").agg(F.max("mark").alias("mark"), F.min(F.when(~F.col("mark"), place)).alias("at")).where("mark")
    asked = least.groupBy(F.xxhash64("at.key", "at.th").alias("row")).agg(F.collect_list("name").alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, 0):
            found = Paragraphs(texts)
            own = found.names().view(np.int64)
            asked = batch.column(1).to_pylist()
            ends = np.searchsorted(found.doc, np.arange(len(texts) + 1))
            at = [np.arange(a, b)[np.isin(own[a:b], n)] for a, b, n in zip(ends, ends[1:], asked, strict=False)]
            chosen = np.concatenate(at) if at else np.zeros(0, np.int64)
            chosen = chosen[found.lengths[chosen] >= SHINGLE]
            yield pa.RecordBatch.from_arrays([pa.array(own[chosen]), pa.array([x.view(np.int64) for x in found.sets(chosen)], pa.list_(pa.int64()))], ["name", "shingles"])

    return _asking(source, asked).select("text", "names").mapInArrow(run, "name bigint, shingles array<bigint>").groupBy("name").agg(F.first("shingles").alias("shingles"))


def jaccard_links(sets: list[np.ndarray], asks: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that connect what the pairs (asking, any) of similarity ``least`` or more connect, fewer than there are sets."""
    if len(sets) == 2:  # most bands
        shared = len(np.intersect1d(*sets, assume_unique=True))
        near = shared >= least * (len(sets[0]) + len(sets[1]) - shared) - 1e-9
        return [(0, 1)] if near and asks.any() else []
    group = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    links = []
    for i in np.flatnonzero(asks).tolist():
        low, high = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], side="right")
        counts = high - low
        at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((shared >= least * (sizes + sizes[i] - shared) - 1e-9) & (group != group[i]))
        if len(near):
            _, firsts = np.unique(group[near], return_index=True)
            links += [(i, int(k)) for k in near[firsts]]
            group[np.isin(group, group[near])] = group[i]
    return links


def near_paragraphs(named: DataFrame, sets: DataFrame, least: float = LEAST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between names of distinct paragraphs that connect all verified pairs.

    ``named``: the bands with two names or more (``shared_bands``), ``sets``: the shingle sets of their names. The bands
    are compared inside tasks, one of over ``block_rows`` paragraphs as pairs of blocks. A task returns a spanning forest,
    never all pairs.
    """
    members = named.join(sets, "name")
    counts = named.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    held = members.join(counts, "band").withColumn("at", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = held.select("band", F.col("at").alias("x"), blocks.alias("y"), "name", "shingles", F.lit(True).alias("asks"))
    met = held.where("blocks > 1").select("band", blocks.alias("x"), F.col("at").alias("y"), "name", "shingles", F.lit(False).alias("asks")).where("x < y")
    dealt = asking.where("x <= y").unionByName(met).withColumn("part", F.xxhash64("band", "x", "y")).repartition("part").sortWithinPartitions("band", "x", "y")

    def links(frame: pd.DataFrame) -> tuple[list, list]:
        left, right = [], []
        band, x, y, names, asks, sets = (frame[c].to_numpy() for c in ("band", "x", "y", "name", "asks", "shingles"))
        starts = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        stops = np.append(starts[1:], len(band))
        several = stops - starts > 1
        for a, b in zip(starts[several].tolist(), stops[several].tolist(), strict=True):
            for i, j in jaccard_links(list(sets[a:b]), asks[a:b], least):
                left.append(names[a + i])
                right.append(names[a + j])
        return left, right

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = None
        for frame in frames:
            if not len(frame):
                continue
            frame = frame if carried is None else pd.concat([carried, frame], ignore_index=True)
            tail = (frame[["band", "x", "y"]] == frame[["band", "x", "y"]].iloc[-1]).all(axis=1).to_numpy()
            start = int(np.argmax(tail))  # sorted: the open group is the tail
            carried = frame.iloc[start:]
            if start:
                a, b = links(frame.iloc[:start])
                yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})
        if carried is not None:
            a, b = links(carried)
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return dealt.select("band", "x", "y", "name", "shingles", "asks").mapInPandas(compare, "a bigint, b bigint")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, least_words: int = LEAST_WORDS) -> DataFrame:
    """The paragraphs that repeat, one row each: key, number (in its document), words, component_doc, component_number, removed.

    A component holds paragraphs of equal text or of similarity ``least`` or more, directly or through others. Its first
    paragraph (by key, then number) names it and stays. Others are removed if they and the repeating paragraphs beside
    them have ``least_words`` words together. Only components that lose a paragraph are returned. Null and empty texts
    have no paragraphs, nor have texts of under five words; null keys come last, each of their texts by itself; rows that
    repeat a key and text count once; an empty table gives none; other columns are ignored. Equal texts are known by 64-bit hashes (a chance of n^2 / 2^65 of any mix-up).
    """
    folder = shared_path(docs.sparkSession, "texts")
    source, kind = laid_out(docs.select(key, text), key, text, folder)
    found = _passages(source, kind, key, least, least_words)
    dropped(docs.sparkSession, folder)
    return found.drop("_lf_text")


def _passages(source: DataFrame, kind: str, key: str, least: float, least_words: int, results: str | None = None) -> DataFrame:
    """``repeated_passages`` of laid out texts, with the text's hash ``_lf_text``; it reads tables in ``results`` alone."""
    first, folder = (shared_path(source.sparkSession, x) for x in ("paragraphs", "passages"))
    every = written(occurrences(source, kind), "paragraphs", first)
    named = written(shared_bands(every.select(F.explode("bands").alias("band"), "name")), "named", folder)
    # names that stand in one place and share no band are done with here; a mark is a row for a name in a shared band
    columns = "key", "th", "number", "words", "name"
    marks = named.select(*[F.lit(None).cast(every.schema[c].dataType).alias(c) for c in columns[:-1]], "name", F.lit(True).alias("mark"))
    places = written(recurring(every.select(*columns, F.lit(False).alias("mark")).unionByName(marks), "name"), "places", folder)
    dropped(source.sparkSession, first)
    sets = written(shingle_sets(source, places), "sets", folder)
    linked = connected_components(near_paragraphs(named, sets, least), "a", "b", folder=folder)
    places = places.where("not mark")
    copied = places.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    wanted = written(copied.unionByName(linked.select(F.col("node").alias("name"))).distinct().join(linked, F.col("name") == linked["node"], "left").select("name", F.coalesce("component", "name").alias("component")), "wanted", folder)
    held = written(places.join(broadcast_if_small(wanted, SMALL), "name").select("key", "th", "number", "words", "component").distinct(), "held", folder)
    place = F.struct(F.col("key").isNull().alias("last"), "key", "th", "number")
    # written sides, here and in _runs: each join's shuffle is apart from the sums', so that Spark can split a large component
    firsts = written(held.groupBy("component").agg(F.min(place).alias("first")), "firsts", folder)
    marked = held.join(broadcast_if_small(firsts, SMALL), "component").withColumn("again", place != F.col("first"))
    runs = _runs(marked, least_words, results)
    dropped(source.sparkSession, folder)
    return runs.select(F.col("key").alias(key), F.col("th").alias("_lf_text"), "number", "words", F.col("first.key").alias("component_doc"), F.col("first.number").alias("component_number"), "removed")


def _runs(marked: DataFrame, least_words: int, folder: str | None = None) -> DataFrame:
    """``marked`` with ``removed``, without the components that lose nothing. Runs are found inside a document's text."""
    ordered = Window.partitionBy("key", "th").orderBy("number")
    runs = marked.where("again").withColumn("run", F.col("number") - F.dense_rank().over(ordered))
    runs = runs.withColumn("together", F.sum("words").over(Window.partitionBy("key", "th", "run")))
    gone = runs.withColumn("removed", F.col("together") >= least_words).drop("run", "together")
    every = written(gone.unionByName(marked.where("not again").withColumn("removed", F.lit(False))), "runs", folder)
    losing = written(every.where("removed").select("component").distinct(), "losing", folder)
    return every.join(broadcast_if_small(losing, SMALL), "component", "left_semi")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _lf_text, start, stop, origin): the words of each text that stand in an earlier place too, LEAST_RUN or more in a row.

    A place is earlier by key (null last), text hash ``_lf_text`` and word; ``origin`` is the key where the span's first
    words stand first. Of every window of LEAST_RUN words (A-Z as a-z) that repeats, all but the first go, and so do all
    words they cover; a repeat that overlaps the first in the same text stays. Rows that repeat a key and text are one.
    First anchors that stand in one place are dropped; then equal blocks are settled as one row each; only blocks whose
    anchor has other surroundings elsewhere are opened to their windows. The rows are a written table.
    """
    folder = shared_path(docs.sparkSession, "texts")
    source, kind = laid_out(docs.select(key, text), key, text, folder)
    spans = _spans(source, kind, key)
    dropped(docs.sparkSession, folder)
    return spans


def _spans(source: DataFrame, kind: str, key: str, results: str | None = None) -> DataFrame:
    """``repeated_spans`` of laid out texts, as a table in ``results``."""
    folder = shared_path(source.sparkSession, "windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, 2):
            found = Windows(texts)
            doc = pa.array(found.doc)
            numbers = [pa.array(x.astype(np.int32)) for x in (found.start, found.n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), *numbers, _signed(found.anchor), _signed(found.block)], ["key", "th", "start", "n", "anchor", "block"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, 2):
            found = Windows(texts)
            asked = [(i, b["start"], b["n"]) for i, own in enumerate(batch.column(3).to_pylist()) for b in own]
            doc = pa.array([i for i, _, n in asked for _ in range(n)], pa.int64())
            start = pa.array([at + k for _, at, n in asked for k in range(n)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), start, _signed(np.concatenate([np.zeros(0, np.uint64), *[found.of(*a) for a in asked]]))], ["key", "th", "start", "window"])

    place = F.struct(F.col("key").isNull().alias("last"), "key", "th", "start")
    later = ~(F.col("key").eqNullSafe(F.col("first.key")) & (F.col("th") == F.col("first.th")) & (F.col("start") - F.col("first.start") < LEAST_RUN))
    where = F.xxhash64("key", "th", "start")
    blocks = source.select("key", "th", "text").mapInArrow(cut, f"key {kind}, th bigint, start int, n int, anchor bigint, block bigint")
    blocks = written(recurring(blocks, "anchor"), "blocks", folder)
    anchors = blocks.groupBy("anchor").agg(F.min(where).alias("a"), F.max(where).alias("b"), F.min("block").alias("c"), F.max("block").alias("d"))
    anchors = written(anchors.where("a <> b").select("anchor", F.expr("c <> d").alias("differ")), "anchors", folder)
    held = written(blocks.join(broadcast_if_small(anchors, SMALL), "anchor").drop("anchor"), "anchored", folder)
    firsts = written(held.groupBy("block").agg(F.min(place).alias("first")), "firsts", folder)
    judged = written(held.join(broadcast_if_small(firsts, SMALL), "block").withColumn("later", later), "judged", folder)
    whole = judged.where("later").select("key", "th", "start", (F.col("start") + F.col("n") + (LEAST_RUN - 1)).alias("stop"), F.col("first.key").alias("origin"))
    asked = judged.where("differ and not later").groupBy(F.xxhash64("key", "th").alias("row")).agg(F.collect_list(F.struct("start", "n")).alias("blocks"))
    windows = _asking(source, asked).select("key", "th", "text", "blocks").mapInArrow(opened, f"key {kind}, th bigint, start int, window bigint")
    windows = written(recurring(windows, "window"), "windows", folder)
    twice = windows.groupBy("window").agg(F.min(place).alias("first"), F.min(where).alias("a"), F.max(where).alias("b"))
    twice = written(twice.where("a <> b").select("window", "first"), "twice", folder)
    single = windows.join(broadcast_if_small(twice, SMALL), "window").where(later).select("key", "th", "start", (F.col("start") + LEAST_RUN).alias("stop"), F.col("first.key").alias("origin"))
    before = Window.partitionBy("key", "th").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key", "th").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    every = whole.unionByName(single).withColumn("new", F.when(F.col("start") <= F.max("stop").over(before), 0).otherwise(1))
    spans = every.withColumn("span", F.sum("new").over(upto)).groupBy("key", "th", "span")
    merged = spans.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("origin", "start").alias("origin"))
    found = written(merged.select(F.col("key").alias(key), F.col("th").alias("_lf_text"), "start", "stop", "origin"), "spans", results)
    dropped(source.sparkSession, folder)
    return found


def passages_and_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``repeated_passages`` and ``repeated_spans`` in one table; a span has ``first_word`` instead of paragraph numbers."""
    folder = shared_path(docs.sparkSession, "texts")
    source, kind = laid_out(docs.select(key, text), key, text, folder)
    passages, spans = _passages(source, kind, key, LEAST, LEAST_WORDS).drop("_lf_text"), _spans(source, kind, key)
    dropped(docs.sparkSession, folder)
    rows = spans.select(key, F.lit(None).cast("int").alias("number"), (F.col("stop") - F.col("start")).alias("words"), F.col("origin").alias("component_doc"), F.lit(None).cast("int").alias("component_number"), F.lit(True).alias("removed"), F.col("start").alias("first_word"))
    return passages.withColumn("first_word", F.lit(None).cast("int")).unionByName(rows)


def cut_passages(text: bytes, gone: set[int], spans: list[tuple[int, int]] = ()) -> str:
    """The text without the paragraphs of the given numbers and the given words, and without lines that this empties."""
    found = Paragraphs([text])
    stays = np.repeat(~np.isin(found.number, list(gone)), found.lengths)
    for start, stop in spans:
        stays[start:stop] = False
    first, lines = 0, []
    for line in text.split(b"\n"):
        words = line.split()
        own = stays[first : first + len(words)].tolist()
        first += len(words)
        if all(own):
            lines.append(line)
            continue
        kept, at = [], 0
        for i, (word, stay) in enumerate(zip(words, own, strict=True)):
            begin, at = at, line.index(word, at) + len(word)
            if stay:
                kept.append(line[begin : len(line) if i == len(words) - 1 else at])
        if kept:
            out = b"".join(kept)
            lines.append(out if line.startswith(b" ") else out.lstrip(b" "))
    return b"\n".join(lines).decode()


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", least: float = LEAST, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the removed paragraphs and repeated spans cut out of their texts, all rows and columns kept.

    ``length`` names a column that is set to the new text's length in characters. Documents without removals pass as
    they are, null texts and keys too; a text is cut by its own removals, whatever else stands under its key; rows that
    repeat a key and text are cut alike. Only the numbers of removed paragraphs and the bounds of spans are moved to the documents, which are read from where ``laid_out`` put them.
    """
    spark, names = docs.sparkSession, [f"c{i}" for i in range(len(docs.columns))]
    source, kind = laid_out(docs, key, text, shared_path(spark, "texts"))
    row, results = F.xxhash64(key, "_lf_text").alias("row"), shared_path(spark, "found")
    gone = written(_passages(source, kind, key, least, least_words, results).where("removed").groupBy(row).agg(F.collect_set("number").alias("gone")), "removals")
    spans = written(_spans(source, kind, key, results).groupBy(row).agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    dropped(spark, results)
    plain = _asking(_asking(source, gone, "left"), spans, "left").select(*names, "gone", "spans")
    at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, at):
            gone, spans = (batch.column(len(names) + k).to_pylist() for k in (0, 1))
            new = [cut_passages(t, set(g or ()), [(x["start"], x["stop"]) for x in s or ()]) if t is not None else None for t, g, s in zip(texts, gone, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names)

    changed = plain.where("gone is not null or spans is not null").mapInArrow(cut, ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True)))
    rest = plain.where("gone is null and spans is null").select(names)
    if length in docs.columns:
        changed = changed.withColumn(names[docs.columns.index(length)], F.length(names[at]).cast(docs.schema[length].dataType))
    return rest.unionByName(changed).toDF(*docs.columns)
