"""Operator 11: the tokens of two tokenizers aligned by merge-path partitioning.

Both tokenizers cut the same bytes, so the ends of their tokens are two sorted lists. Where both have an end, the text
falls into groups. The two lists of a slice of documents are merged in pieces of equal work: binary searches along
diagonals of the merge grid find where each piece begins, every piece then emits its overlaps independently of the others
(all pieces side by side, as arrays), and groups that a piece's border cuts are stitched by the number of common ends
before it. Id pairs are counted over all documents by a sum of sums, and the counts go back to the documents by slice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import text_slices, written
from locusframe.llm.token_cache import TextEncoder, as_bytes, byte_letters

#: Merge steps of a piece; text bytes encoded together; text bytes whose id pairs share a dictionary (a slice).
WORK, BYTES, SLICE = 256, 1_500_000, 8_000_000
#: Links made at once while pairs are counted.
_LINKS = 1 << 21
#: Groups with more links than this are counted by their distinct ids on both sides.
_LARGE = 256
#: Words whose ids a worker keeps.
_WORDS = 200_000


class PlainByteEncoder(TextEncoder):
    """A byte-level vocabulary in which special tokens' strings are ordinary text; ``bytes_of[i]`` are the bytes of id i."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        if self.word_ends:
            raise ValueError("a byte-level vocabulary is needed")
        self.tokenizer = Tokenizer.from_file(path)  # one of its own: the setting below holds for all its callers
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        code = {letter: value for value, letter in enumerate(byte_letters())}
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        spelt = [names.get(i, "") for i in range(max(names) + 1)]
        self.bytes_of = pa.array([bytes(code[x] for x in t) if all(x in code for x in t) else t.encode() for t in spelt], pa.large_binary())


class SpacedPieces:
    """A sentencepiece model whose pieces have spaces at their beginning only, so that words are encoded one by one.

    A text's words (each with the spaces before it) are encoded once for each distinct one in a slice of texts.
    """

    _MARK = "▁"  # fixed value: stands for a space in pieces

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelt = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        if any(re.search(f"[^{self._MARK}]{self._MARK}", p) for p in spelt):
            raise ValueError("a model with pieces across words")
        self.bytes_of = pa.array([bytes.fromhex(m[1]) if (m := byte.fullmatch(p)) else p.replace(self._MARK, " ").encode() for p in spelt], pa.large_binary())
        self.alone = as_bytes([self.model.piece_to_id(self._MARK)])  # a space at a text's end
        self.known: dict[str, bytes] = {}  # ids of words, as bytes

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text in them); the model itself puts a space before a text. No empty texts."""
        odd = pc.match_substring_regex(texts, "^ |  | $")
        lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        if pc.any(odd).as_py():
            runs = [[w[1:] for w in re.findall(" +[^ ]*", " " + t)] for t in texts.filter(odd).to_pylist()]
            at = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"))
            lists = pa.concat_arrays([lists, pa.array(runs, lists.type)]).take(pa.array(at))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > _WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        found = dict(zip(new, map(as_bytes, self.model.encode(new, num_threads=1)), strict=True))
        found[""] = self.alone
        spelt = [self.known.get(w) or found[w] for w in words]
        self.known |= {w: ids for w, ids in found.items() if len(w) <= 64}
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt)) // 4
        values, first = np.frombuffer(b"".join(spelt), "<u4"), np.concatenate([[0], np.cumsum(sizes)])
        at = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return values[np.repeat(first[at] - ends[:-1], each) + np.arange(ends[-1])], ends[offsets]


@lru_cache(maxsize=2)
def encoders(first: str, second: str) -> tuple[PlainByteEncoder, SpacedPieces]:
    """The worker's own encoders, with their caches."""
    return PlainByteEncoder(first), SpacedPieces(second)


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> np.ndarray:
    """How many of the first d merged ends come from ``a``, for d = 0, work, 2 work, ...: one binary search a diagonal, all at once.

    Of equal ends that of ``a`` comes first.
    """
    d = np.arange(0, len(a) + len(b) + work, work).clip(max=len(a) + len(b))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        takes = np.zeros(len(d), bool)  # a[middle] is among the first d
        inner = low < high
        takes[inner] = a[middle[inner]] <= b[d[inner] - middle[inner] - 1]
        low, high = np.where(inner & takes, middle + 1, low), np.where(inner & ~takes, middle, high)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, int]:
    """(group of each token of a, group of each token of b, number of groups) from the tokens' ends, which end alike.

    Piece p merges its ``work`` ends from its place on the diagonals. Its overlaps are numbered by the common ends before
    them in the piece; then the pieces' numbers of common ends, summed up, stitch the groups that borders cut.
    """
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    total = len(a) + len(b)
    i = diagonals(a, b, work)
    j = np.arange(0, total + work, work).clip(max=total) - i
    i, j, last_i, last_j = i[:-1].copy(), j[:-1].copy(), i[1:], j[1:]
    a, b = np.append(a, a[-1] + 1), np.append(b, b[-1] + 1)
    of_a, of_b, common = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), np.zeros(len(i), np.int64)
    piece_a, piece_b = np.repeat(np.arange(len(i)), last_i - i), np.repeat(np.arange(len(i)), last_j - j)
    for _ in range(work):
        open_ = (i < last_i) | (j < last_j)
        end_a, end_b = a[i], b[j]
        takes_a = (end_a <= end_b) & open_
        takes_b = ~takes_a & open_
        # the token whose end is taken lies in the group that is open there
        of_a[i[takes_a]] = common[takes_a]
        of_b[j[takes_b]] = common[takes_b]
        # b's end closes the group if a's end before it is the same
        common += takes_b & (i > 0) & (a[i - 1] == end_b)
        i, j = i + takes_a, j + takes_b
    before = np.cumsum(common) - common
    return of_a[:-1] + before[piece_a], of_b[:-1] + before[piece_b], int(common.sum())


def _expanded(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... (counts of them) for each begin in ``values``."""
    ends = np.cumsum(counts)
    return np.repeat(values - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _distinct(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights (1 each)."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=weights, minlength=len(keys)).astype(np.int64)


class Aligned:
    """The documents of a batch: tokens, groups and id pairs."""

    def __init__(self, texts: pa.Array, first: PlainByteEncoder, second: SpacedPieces):
        self.count, self.width = len(texts), len(second.bytes_of)
        self.rows = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
        texts = texts.take(pa.array(self.rows))
        spaced = pc.binary_join_element_wise("", texts, " ")
        self.a, at_a = first.encode_all(spaced) if len(texts) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        self.b, at_b = second.encode_all(texts) if len(texts) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        same = self._spells(first.bytes_of, self.a, at_a, spaced) & self._spells(second.bytes_of, self.b, at_b, spaced)
        if not same.all():
            self.a, self.b = self.a[np.repeat(same, np.diff(at_a))], self.b[np.repeat(same, np.diff(at_b))]
            at_a, at_b = (np.concatenate([[0], np.cumsum(np.diff(x)[same])]) for x in (at_a, at_b))
            self.rows = self.rows[same]
        self.a, self.b = self.a.astype(np.int64), self.b.astype(np.int64)
        self.n_a, self.n_b = np.diff(at_a), np.diff(at_b)
        ends = [np.cumsum(pc.binary_length(x.bytes_of).to_numpy(zero_copy_only=False)[ids].astype(np.int64)) for x, ids in ((first, self.a), (second, self.b))]
        self.group_a, self.group_b, groups = overlaps(*ends)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        self.doc_a = np.repeat(np.arange(len(self.rows)), self.n_a)
        self.doc = self.doc_a[np.cumsum(self.in_a) - 1] if groups else np.zeros(0, np.int64)  # of each group
        self.groups = np.bincount(self.doc, minlength=len(self.rows))
        self.links = np.bincount(self.doc, weights=self.in_a * self.in_b, minlength=len(self.rows)).astype(np.int64)

    @staticmethod
    def _spells(bytes_of: pa.Array, ids: np.ndarray, at: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Which texts the tokens spell."""
        if not len(texts):
            return np.zeros(0, bool)
        return pc.equal(_joined(bytes_of, ids, at), texts.cast(pa.large_string()).cast(pa.large_binary())).to_numpy(zero_copy_only=False)

    def told(self) -> list[bytes]:
        """The groups of each document as text: ``a1,a2|b1;a3|b2,b3``."""
        most = int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1
        before_a, before_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        order_a, order_b = np.arange(len(self.a)), np.arange(len(self.b))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        head_a, head_b = order_a == before_a[self.group_a], order_b == before_b[self.group_b]
        opening = head_a & (self.doc_a != np.concatenate([[-1], self.doc_a[:-1]]))
        codes[order_a + before_b[self.group_a]] = self.a + most * np.where(opening, 0, np.where(head_a, 1, 2))
        codes[order_b + (before_a + self.in_a)[self.group_b]] = self.b + most * np.where(head_b, 3, 2)
        return _joined(_numbers(most), codes, np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])).to_pylist()

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, a * width + b, links) of each distinct id pair of each document, in order."""
        product = self.in_a * self.in_b
        begin_b = np.cumsum(self.in_b) - self.in_b
        span = self.width * (int(self.a.max(initial=0)) + 1)
        small = product <= _LARGE
        found = []
        tokens = np.flatnonzero(small[self.group_a])
        sizes = self.in_b[self.group_a[tokens]]
        for some in _parts(sizes, _LINKS):
            token, size = tokens[some], sizes[some]
            right = self.b[_expanded(begin_b[self.group_a[token]], size)]
            found.append(_distinct(np.repeat(self.doc_a[token] * span + self.a[token] * self.width, size) + right))
        # large groups: distinct ids on both sides with their numbers
        for group in np.flatnonzero(~small).tolist():
            (left, n_left), (right, n_right) = (np.unique(ids[np.searchsorted(of, group) : np.searchsorted(of, group, "right")], return_counts=True) for ids, of in ((self.a, self.group_a), (self.b, self.group_b)))
            for some in _parts(np.full(len(left), len(right)), _LINKS):
                keys = (self.doc[group] * span + left[some] * self.width)[:, None] + right
                found.append(_distinct(keys.ravel(), (n_left[some][:, None] * n_right).ravel()))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        keys, links = _distinct(*map(np.concatenate, zip(*found, strict=True))) if len(found) > 1 else found[0]
        return keys // span, keys % span, links


def _joined(names: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """The names of ``ids`` put together from each place of ``at`` to the next."""
    taken = names.take(pa.array(ids))
    _, ends, data = taken.buffers()
    ends = np.frombuffer(ends, np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends[at]), data])


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of ``sizes`` whose sum is ``most`` at most (one at least)."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


@lru_cache(maxsize=2)
def _numbers(most: int) -> pa.Array:
    """The numbers below ``most`` after nothing, ``;``, ``,`` and ``|``, one list after the other."""
    return pa.array([mark + str(i) for mark in ("", ";", ",", "|") for i in range(most)], pa.large_binary())


def _unsigned(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


class _Slices:
    """Rows of a task: one a document (with its id pairs as codes of a slice's dictionary), and the dictionaries."""

    def __init__(self, names: list[str], groups: bool):
        self.names, self.groups, self.number = names, groups, 0
        self.docs, self.doc, self.keys, self.links, self.size = [], [], [], [], 0

    def add(self, keys: pa.Array, texts: pa.Array, aligned: Aligned) -> None:
        doc, pair, links = aligned.pairs()
        self.doc.append(aligned.rows[doc] + sum(len(k) for k, *_ in self.docs))
        self.keys.append(pair)
        self.links.append(links)
        whole = np.zeros((4, aligned.count), np.int64)
        whole[:, aligned.rows] = aligned.n_a, aligned.n_b, aligned.groups, aligned.links
        told = aligned.told()
        digests, texts_of = [""] * aligned.count, [None] * aligned.count
        for row, text in zip(aligned.rows.tolist(), told, strict=True):
            digests[row] = hashlib.sha256(text).hexdigest()
            texts_of[row] = text.decode() if self.groups else None
        self.docs.append((keys, whole, digests, texts_of))
        self.size += pc.sum(pc.binary_length(texts)).as_py() or 0

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        """The slice: its documents in batches, then its dictionary in chunks."""
        if not self.docs:
            return
        number, names = part << 32 | self.number, self.names
        doc, pair, links = (np.concatenate(x) for x in (self.doc, self.keys, self.links))
        known, codes = np.unique(pair, return_inverse=True)
        held = np.bincount(codes, minlength=len(known))
        begin = 0
        for keys, whole, digests, texts_of in self.docs:
            at = np.searchsorted(doc, np.arange(begin, begin + len(keys) + 1))
            own = [_unsigned(codes[x:y], "<u4") for x, y in zip(at, at[1:], strict=False)]
            sums = [_unsigned(links[x:y], "<u4") for x, y in zip(at, at[1:], strict=False)]
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(keys)), none, keys, *map(pa.array, whole), pa.array(digests), pa.array(texts_of, pa.string()), pa.array(own, pa.binary()), pa.array(sums, pa.binary())], names)
            begin += len(keys)
        for place in range(0, len(known), 1 << 16):
            some = slice(place, place + (1 << 16))
            empty = [pa.nulls(1, k) for k in (keys.type, *[pa.int64()] * 4, pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([place]), *empty, pa.array([_unsigned(known[some], "<i8")], pa.binary()), pa.array([_unsigned(held[some], "<u4")], pa.binary())], names)
        self.number += 1
        self.docs, self.doc, self.keys, self.links, self.size = [], [], [], [], 0


def aligned_slices(docs: DataFrame, first: str, second: str, key: str, text: str, groups: bool) -> DataFrame:
    """A written table of documents (place is null) and dictionaries of id pairs (place is their first code), by slice.

    A task aligns its texts once; documents keep their distinct pairs as codes and numbers of links.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    names = ["slice", "place", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "codes", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), _Slices(names, groups)
        for batch in text_slices(batches, 1, BYTES):
            texts = batch.column(1).cast(pa.string())
            own.add(batch.column(0), texts, Aligned(texts, *encoders(first, second)))
            if own.size >= SLICE:
                yield from own.rows(part)
        yield from own.rows(part)

    kind = source.schema["key"].dataType.simpleString()
    schema = f"slice bigint, place bigint, key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, codes binary, sums binary"
    return written(source.mapInArrow(run, schema), "aligned")


def dictionary_rows(slices: DataFrame) -> DataFrame:
    """(slice, code, pair, docs) of each entry of the dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, place, pairs, held in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                pair, docs = np.frombuffer(pairs, "<i8"), np.frombuffer(held, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), number)), pa.array(place + np.arange(len(pair))), pa.array(pair), pa.array(docs)], ["slice", "code", "pair", "docs"])

    return slices.where("place is not null").select("slice", "place", "codes", "sums").mapInArrow(run, "slice bigint, code bigint, pair bigint, docs bigint")


def pair_counts(entries: DataFrame, width: int) -> DataFrame:
    """(pair, a, b, docs, best): in how many documents an id pair is linked, and whether no pair of its ``a`` is in more.

    The highest count of each ``a`` is broadcast: a row an id, bounded by the first vocabulary.
    """
    sums = written(entries.groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs").withColumn("a", F.expr(f"pair div {width}"))
    most = sums.groupBy("a").agg(F.max("docs").alias("most"))
    return sums.join(F.broadcast(most), "a").select("pair", "a", (F.col("pair") % width).alias("b"), "docs", (F.col("docs") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """One row a document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and (``groups``) the groups.

    ``first`` is a byte-level vocabulary file, ``second`` a sentencepiece model. Null and empty texts, and those that
    either tokenizer doesn't spell byte by byte, have no tokens: zeros and an empty digest. Null keys and repeated rows pass
    through, each as a document of its own; other columns are ignored. Texts are encoded once; what is shuffled are the
    slices' dictionaries (one entry a distinct pair and slice) and the documents' codes.
    """
    slices = aligned_slices(docs, first, second, key, text, groups)
    width = len(encoders(first, second)[1].bytes_of)
    entries = dictionary_rows(slices)
    counted = entries.join(pair_counts(entries, width).select("pair", F.col("docs").alias("n"), "best"), "pair").select("slice", "code", "n", "best")
    kind = slices.schema["key"].dataType.simpleString()
    kept = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * groups]

    def sums(documents: pa.Table, counts: pa.Table) -> pa.Table:
        """One slice: bounded by the slice's bytes of text."""
        n, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
        at = counts.column("code").to_numpy()
        n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
        n_best, count_sum = [], []
        for codes, links in zip(documents.column("codes").to_pylist(), documents.column("sums").to_pylist(), strict=True):
            codes, links = np.frombuffer(codes, "<u4"), np.frombuffer(links, "<u4").astype(np.int64)
            n_best.append(int((links * best[codes]).sum()))
            count_sum.append(int((links * n[codes]).sum()))
        return pa.table([*[documents.column(c) for c in kept], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=[*kept, "n_best", "count_sum"])

    types = {"key": kind, "groups_sha256": "string", "groups": "string"}
    schema = ", ".join(f"{c} {types.get(c, 'bigint')}" for c in [*kept, "n_best", "count_sum"])
    documents = slices.where("place is null").select("slice", *kept, "codes", "sums")
    found = documents.groupBy("slice").cogroup(counted.groupBy("slice")).applyInArrow(sums, schema)
    order = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups]
    return found.select(order).withColumnRenamed("key", key)
