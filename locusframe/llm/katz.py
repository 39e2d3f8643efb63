"""Operator 9: a Katz backoff language model, learnt from a document table and evaluated on all of it.

A token is predicted from the word before it, its history. With r the training count of (history, word), c that of the
history, and d the Good-Turing discounts (r up to CUT):

    P(word | history) = d(r) r / (c + 1)               if r > 0
                      = weight(history) P(word)        otherwise, with
    weight(history)   = (1 - sum over seen words of d(r) r / (c + 1)) / (1 - sum over seen words of P(word))
    P(word)           = discounted share of its count; what the discounts free is the share of unknown words.

Both levels sum to one over the vocabulary and one unknown word, whatever the counts (the + 1 keeps some weight for new
words after a history whose counts are all high). A history that was never seen backs off with weight 1.

The text is read twice. First words are counted. Then each slice of documents sends its tokens, grouped by word and
history and packed, to the word's bucket: there all counts of the word and of its pairs meet. The bucket sends each pair's
count to the bucket of its history, each token's counts back to its slice, and each token whose pair was never seen to
its history. The written table of that step (``ngrams2``) is the model's counts, a row a history bucket or word bucket;
weights follow from it without another shuffle, as a table too, and reach the unseen tokens where they lie. Words with
over 1 / HOT of all tokens (so at most HOT of them) are dealt out: as words by their histories, as histories by the words
after them; their counts and weights are the only ones that every task gets.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import text_batches, written

CUT = 5
HOT = 4096
BUCKET_TOKENS = 1_000_000
SLICE_BYTES = 8_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BEGIN, _END = 1, 2  # codes of the places before a text and after it


class _Codes(dict):
    """word -> 64-bit code of its lower case."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word.translate(_LOWER))
        if len(self) >= 250_000:
            self.clear()
        if len(word) <= 64:
            self[word] = code
        return code


_codes = _Codes()


def held_out(key) -> bool:
    """Whether a document is kept from training: CRC-32 of its key as text, mod 5, is 1 (a null key is the empty text)."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % 5 == 1


class Slice:
    """The tokens of some documents: word, history (places in ``words``) and document of each; every document ends in one end token."""

    def __init__(self, texts: list[bytes | None]):
        parts, self.lengths = [], []
        for text in texts:
            words = (text or b"").split()
            part = np.empty(len(words) + 2, np.uint64)
            part[0], part[-1] = _BEGIN, _END
            part[1:-1] = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
            parts.append(part)
            self.lengths.append(len(words) + 1)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        token = np.ones(len(flat), bool)
        token[np.cumsum([0, *[n + 1 for n in self.lengths[:-1]]])[: len(parts)].astype(np.int64)] = False
        self.words, at = np.unique(flat, return_inverse=True)
        self.word = at[token]
        self.history = at[:-1][token[1:]]
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)


@dataclass(frozen=True)
class Discounts:
    """Good-Turing discounts d(1) to d(CUT); higher counts are not discounted."""

    factors: tuple[float, ...]

    @classmethod
    def of(cls, n: list[float]) -> Discounts:
        """From the counts of counts n(1) to n(CUT + 1), by Katz's formula; where they give no value in (0, 1], 1."""
        common = (CUT + 1) * n[CUT] / n[0] if n[0] else 1.0
        out = []
        for r in range(1, CUT + 1):
            d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common < 1 else 1.0
            out.append(d if 0 < d <= 1 else 1.0)
        return cls(tuple(out))

    def __call__(self, r: np.ndarray) -> np.ndarray:
        return np.array([1.0, *self.factors, 1.0])[np.minimum(r, CUT + 1)]


@dataclass(frozen=True)
class Unigrams:
    """P(word) by its training count, and the base score's terms."""

    tokens: int
    words: int
    discounts: Discounts
    scale: float
    unknown: float
    documents: int

    @classmethod
    def of(cls, tokens: int, words: int, n: list[int], high: int, documents: int) -> Unigrams:
        """``n``: counts of counts 1 to CUT + 1; ``high``: tokens of words seen more than CUT times; ``documents``: training texts."""
        discounts = Discounts.of(n)
        seen = (high + sum(d * r * n[r - 1] for r, d in enumerate(discounts.factors, 1))) / tokens if tokens else 0.0
        unknown = max(1 - seen, 1 / (tokens + 1))
        return cls(tokens, words, discounts, (1 - unknown) / seen if seen else 0.0, unknown, documents)

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.scale * self.discounts(count) * count / max(self.tokens, 1), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: ascending codes as differences, and the bytes of each place of all numbers together."""
    told, parts = [], []
    for a in arrays:
        ascending = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        told.append([a.dtype.str, len(a), int(ascending)])
        x = np.diff(a, prepend=np.uint64(0)) if ascending else np.ascontiguousarray(a)
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")
    head = json.dumps(told).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(parts))


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n, ascending in json.loads(raw[4:at]):
        size = n * np.dtype(kind).itemsize
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(-1, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind)
        out.append(np.cumsum(x, dtype=np.uint64) if ascending else x)
        at += size
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (an odd multiplier; a fixed value)."""
    return (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)


def _bucket(code: np.ndarray, spread: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each code; hot ones are dealt out by ``spread``."""
    extra = np.where(np.isin(code, hot), _mixed(spread + np.uint64(1)), np.uint64(0))
    return ((_mixed(code ^ extra) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def count_training(source: DataFrame) -> DataFrame:
    """(code, n): training counts of words; the end token's is the number of documents, and so of their beginnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, 1, SLICE_BYTES):
            found = Slice([t for k, t in zip(batch.column(0).to_pylist(), texts, strict=True) if not held_out(k)])
            words, n = np.unique(found.word, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.words[words].view(np.int64)), pa.array(n)], ["code", "n"])

    return source.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


_SENT = "target bigint, kind int, slice bigint, bucket bigint, data binary"
_TYPES = {"target": "int64", "kind": "int32", "slice": "int64", "bucket": "int64"}
#: Kinds of rows that are sent: tokens to their word's bucket; documents, tokens' counts, pairs and unseen tokens after it.
_TOKENS, _DOCS, _COUNTED, _PAIRS, _UNSEEN = range(5)


def _sent(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _SENT.split(", ")]).astype(_TYPES)


def _slice_target(number: int) -> int:
    """Slices and history buckets share one shuffle: slices are below 0."""
    return -1 - number


def send_tokens(source: DataFrame, buckets: int, hot: dict[int, int]) -> DataFrame:
    """The packed tokens of each slice for each word bucket, and the slice's documents."""
    hot_codes = np.array(sorted(hot), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the same number in every attempt of the task
        for nth, (batch, texts) in enumerate(text_batches(batches, 1, SLICE_BYTES)):
            keys = batch.column(0)
            found, number = Slice(texts), TaskContext.get().partitionId() << 32 | nth
            held = np.array([held_out(k) for k in keys.to_pylist()], dtype=np.int64)
            words = found.words
            bucket = _bucket(words[found.word], words[found.history], hot_codes, buckets)
            # by bucket, word, history, and document (a stable sort keeps documents ascending)
            order = np.argsort(found.word * len(words) + found.history, kind="stable")
            order = order[np.argsort(bucket[order], kind="stable")]
            bucket, word, history, doc = (x[order] for x in (bucket, found.word, found.history, found.doc))
            starts = _runs(bucket, word, history, doc)
            times = np.diff(starts, append=len(doc))
            bucket, word, history, doc = (x[starts] for x in (bucket, word, history, doc))
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [(-1 - zlib.crc32(str(number).encode()) % buckets, _DOCS, number, -1, _documents(keys, held, found.lengths))]
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[b], cuts[b + 1])
                w, h, d = word[own], history[own], doc[own]
                pairs = _runs(w, h)
                owners = _runs(w[pairs])
                before, at = np.unique(h[pairs], return_inverse=True)
                count = lambda starts, n: np.diff(starts, append=n).astype(np.uint32)
                rows.append((b, _TOKENS, number, b, _packed(words[w[pairs[owners]]], count(owners, len(pairs)), words[before], at.astype(np.uint32), count(pairs, len(d)), (d << 1 | held[d]).astype(np.uint32), times[own].astype(np.uint32))))
            yield pa.RecordBatch.from_pandas(_sent(rows), schema=pa.schema([("target", pa.int64()), ("kind", pa.int32()), ("slice", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())]), preserve_index=False)

    return source.mapInArrow(run, _SENT)


def _documents(keys: pa.Array, held: np.ndarray, lengths: list[int]) -> bytes:
    sink = pa.BufferOutputStream()
    rows = pa.record_batch([keys, pa.array(held.astype(bool)), pa.array(lengths, pa.int64())], ["key", "held", "n"])
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    return sink.getvalue().to_pybytes()


def count_words(sent: DataFrame, buckets: int, hot: dict[int, int]) -> DataFrame:
    """What each word bucket makes of its tokens, on its way: pairs and unseen tokens to history buckets, counts to slices."""
    hot_codes = np.array(sorted(hot), dtype=np.uint64)
    hot_counts = np.array([hot[int(c)] for c in hot_codes], dtype=np.int64)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        if group["kind"].iloc[0] == _DOCS:
            return group.assign(target=[_slice_target(n) for n in group["slice"]])
        bucket, slices = int(group["bucket"].iloc[0]), group["slice"].tolist()
        parts = [_unpacked(d) for d in group["data"]]
        words, word = np.unique(np.concatenate([np.repeat(p[0], p[1]) for p in parts]), return_inverse=True)
        firsts = np.cumsum([0, *[len(p[2]) for p in parts[:-1]]])
        histories, known = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        history = known[np.concatenate([p[3] + f for p, f in zip(parts, firsts, strict=True)])]
        pairs, pair = np.unique(word.astype(np.int64) * len(histories) + history, return_inverse=True)
        own_word, own_history = pairs // len(histories), pairs % len(histories)
        entry = np.repeat(pair, np.concatenate([p[4] for p in parts]))
        held, doc = (np.concatenate([p[5] for p in parts]) & 1).astype(np.int64), np.concatenate([p[5] for p in parts]) >> 1
        times = np.concatenate([p[6] for p in parts]).astype(np.int64)
        r = np.bincount(entry, weights=times * (1 - held), minlength=len(pairs)).astype(np.int64)
        count = np.bincount(own_word, weights=r, minlength=len(words)).astype(np.int64)
        if len(hot_codes):
            at = np.minimum(np.searchsorted(hot_codes, words), len(hot_codes) - 1)
            count = np.where(hot_codes[at] == words, hot_counts[at], count)
        rows = []
        ends = np.cumsum([len(p[5]) for p in parts])
        late_slice, late_entry = [], []
        for number, (a, b) in zip(slices, zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True), strict=True):
            e = entry[a:b]
            runs = _runs(own_word[e])
            first = own_word[e[runs]]
            rows.append((_slice_target(number), _COUNTED, number, bucket, _packed((count[first] << 1 | (words[first] == _END)).astype(np.uint64), np.diff(runs, append=len(e)).astype(np.uint32), r[e].astype(np.uint32), doc[a:b].astype(np.uint32), times[a:b].astype(np.uint32))))
            un = np.flatnonzero(r[e] == 0) + a
            late_entry.append(un)
            late_slice.append(np.full(len(un), number, np.int64))
        # pairs, in order of their words, whose places tell them apart
        spread = np.full(len(pairs), bucket, np.uint64)
        to = _bucket(histories[own_history], spread, hot_codes, buckets)
        seen = np.flatnonzero(r > 0)
        for b, own in _parts(to[seen], seen):
            before, at = np.unique(own_history[own], return_inverse=True)
            rows.append((b, _PAIRS, -1, bucket, _packed(histories[before], at.astype(np.uint32), np.diff(own_word[own], prepend=0).astype(np.uint32), r[own].astype(np.uint32), count[own_word[own]].astype(np.int64))))
        late = np.concatenate(late_entry)
        number = np.concatenate(late_slice)
        for b, own in _parts(to[entry[late]], np.arange(len(late))):
            before, at = np.unique(own_history[entry[late[own]]], return_inverse=True)
            which, place = np.unique(number[own], return_inverse=True)
            rows.append((b, _UNSEEN, -1, bucket, _packed(histories[before], at.astype(np.uint32), which, place.astype(np.uint32), doc[late[own]].astype(np.uint32), times[late[own]].astype(np.uint32))))
        return _sent(rows)

    return sent.groupBy("target").applyInPandas(one, _SENT)


def _parts(bucket: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its items in their order)."""
    order = np.argsort(bucket, kind="stable")
    bucket, items = bucket[order], items[order]
    starts = _runs(bucket)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True) if len(bucket) else ():
        yield int(bucket[a]), items[a:b]


_MET = "kind int, slice bigint, bucket bigint, data binary, " + ", ".join(f"n{k} bigint" for k in range(1, CUT + 2))
_MODEL, _SCORED = 5, 6


def gather(counted: DataFrame, unigrams: Unigrams, hot: dict[int, int]) -> DataFrame:
    """A row a history bucket (``_MODEL``: its histories with their sums, all pair counts, and the unseen tokens), and a row
    a slice (``_SCORED``: its documents with the sums of their tokens, but for pair discounts and backoff weights)."""
    hot_codes = np.array(sorted(hot), dtype=np.uint64)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        columns = [x.split()[0] for x in _MET.split(", ")]
        if (target := int(group["target"].iloc[0])) < 0:
            data = _slice_sums(group, unigrams)
            return pd.DataFrame([(_SCORED, -1 - target, -1, data, *[0] * (CUT + 1))], columns=columns)
        pairs = [_unpacked(d) for d in group["data"][group["kind"] == _PAIRS]]
        owners = group["bucket"][group["kind"] == _PAIRS].tolist()
        unseen = [_unpacked(d) for d in group["data"][group["kind"] == _UNSEEN]]
        whole = lambda x, i, kind: np.concatenate([np.zeros(0, kind), *[p[i] for p in x]]).astype(kind)
        # unseen tokens: history (as a place, or none), slice, document, times; a hot history's pairs may lie elsewhere
        asked = whole([(x[0][x[1]],) for x in unseen], 0, np.uint64)
        own = whole([(x[0][x[1]],) for x in pairs], 0, np.uint64)
        histories, at = np.unique(np.concatenate([own, np.unique(asked[np.isin(asked, hot_codes)])]), return_inverse=True)
        at = at[: len(own)]
        r, count = whole(pairs, 3, np.int64), whole(pairs, 4, np.int64)
        n = len(histories)
        total = lambda x: np.bincount(at, weights=x, minlength=n)
        few = [total(r == k).astype(np.uint32) for k in range(1, CUT + 1)]
        stats = [total(r).astype(np.int64), total(r * (r > CUT)).astype(np.int64), total(unigrams.probability(count))]
        place = np.minimum(np.searchsorted(histories, asked), max(n - 1, 0))
        place = np.where(histories[place] == asked, place, n) if n else np.zeros(len(asked), np.int64)
        known = np.flatnonzero(place < n)  # an unknown history's weight is 1
        slices, doc, times = whole([(x[2][x[3]],) for x in unseen], 0, np.int64), whole(unseen, 4, np.uint32), whole(unseen, 5, np.uint32)
        which, number = np.unique(slices[known], return_inverse=True)
        sizes = np.array([len(p[1]) for p in pairs], dtype=np.uint32)
        table = _packed(histories, *few, *stats, np.array(owners, dtype=np.int64), sizes, at.astype(np.uint32), whole(pairs, 2, np.uint32), r.astype(np.uint32), place[known].astype(np.uint32), which, number.astype(np.uint32), doc[known], times[known])
        return pd.DataFrame([(_MODEL, -1, target, table, *[int((r == k).sum()) for k in range(1, CUT + 2)])], columns=columns)

    return counted.groupBy("target").applyInPandas(one, _MET)


def _slice_sums(group: pd.DataFrame, unigrams: Unigrams) -> bytes:
    """The slice's documents with base score, known tokens, score so far, and how many of their pairs have count 1 to CUT."""
    own = pa.ipc.open_stream(group["data"][group["kind"] == _DOCS].iloc[0]).read_all()
    n = own.num_rows
    score, base, known = (np.zeros(n) for _ in range(3))
    low = np.zeros((CUT, n))
    for data in group["data"][group["kind"] == _COUNTED]:
        told, runs, r, doc, times = _unpacked(data)
        told, r, times = np.repeat(told.astype(np.int64), runs), r.astype(np.int64), times.astype(np.int64)
        count, end = told >> 1, told & 1
        p = np.where(r > 0, np.log10(np.maximum(r, 1)), np.log10(unigrams.probability(count)))
        # as a history the word divides what follows it by its count and one
        p = p - np.where(end == 1, 0.0, np.log10(count + 1.0))
        score += np.bincount(doc, weights=times * p, minlength=n)
        base += np.bincount(doc, weights=times * unigrams.base(count), minlength=n)
        known += np.bincount(doc, weights=times * (count > 0), minlength=n)
        for k in range(CUT):
            low[k] += np.bincount(doc, weights=times * (r == k + 1), minlength=n)
    score -= np.log10(unigrams.documents + 1.0)
    columns = [own.column("key").combine_chunks(), own.column("held").combine_chunks(), own.column("n").combine_chunks(), *map(pa.array, (known.astype(np.int64), base, score, *low))]
    rows = pa.record_batch(columns, ["key", "held", "n", "known", "base", "score", *[f"low{k}" for k in range(CUT)]])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _weights(stats: tuple[np.ndarray, ...], discounts: Discounts) -> np.ndarray:
    """The backoff weights of histories with (n1, ..., nCUT, total, high, low)."""
    *few, total, high, low = stats
    mass = high + sum(d * k * n for k, (d, n) in enumerate(zip(discounts.factors, few, strict=True), 1))
    return (1 - mass / (total + 1.0)) / (1 - low)


def weigh(met: DataFrame, discounts: Discounts, hot: dict[int, tuple[float, int]]) -> DataFrame:
    """(slice, bucket, data): each history bucket's weights (bucket; codes, weights), and what backing off adds to
    documents (slice; document, sum). Hot histories have their weights and counts from ``hot``."""
    codes = np.array(sorted(hot), dtype=np.uint64)
    known = np.array([hot[int(c)] for c in codes], dtype=float).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                histories, *rest = _unpacked(data)
                stats, (place, which, number, doc, times) = rest[: CUT + 3], rest[-5:]
                weight, total = _weights(tuple(stats), discounts), stats[CUT].astype(float)
                if len(codes) and len(histories):
                    at = np.minimum(np.searchsorted(codes, histories), len(codes) - 1)
                    is_hot = codes[at] == histories
                    weight, total = np.where(is_hot, known[at, 0], weight), np.where(is_hot, known[at, 1], total)
                rows = [(-1, bucket, _packed(histories, weight))]
                # an unseen token isn't divided by its history's count, as _slice_sums did
                adds = (np.log10(weight) + np.log10(total + 1.0))[place] * times if len(place) else np.zeros(0)
                for i, own in _parts(number.astype(np.int64), np.arange(len(number))):
                    docs, d = np.unique(doc[own], return_inverse=True)
                    rows.append((int(which[i]), -1, _packed(docs, np.bincount(d, weights=adds[own]))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["slice", "bucket", "data"])

    return met.where(F.col("kind") == _MODEL).select("bucket", "data").mapInArrow(run, "slice bigint, bucket bigint, data binary")


def hot_histories(met: DataFrame, discounts: Discounts, hot: dict[int, int], documents: int) -> dict[int, tuple[float, int]]:
    """(weight, count) of each hot history, whose pairs lie in several buckets: at most HOT rows reach the driver."""
    codes = np.array(sorted(hot), dtype=np.uint64)
    names = [f"s{k}" for k in range(CUT + 3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                histories, *rest = _unpacked(data)
                at = np.flatnonzero(np.isin(histories, codes))
                yield pa.RecordBatch.from_arrays([pa.array(histories[at].view(np.int64)), *[pa.array(x[at].astype(float)) for x in rest[: CUT + 3]]], ["code", *names])

    found = met.where(F.col("kind") == _MODEL).select("data").mapInArrow(run, "code bigint, " + ", ".join(f"{n} double" for n in names))
    sums = found.groupBy("code").agg(*[F.sum(n).alias(n) for n in names]).collect()
    return {r["code"] % 2**64: (float(_weights(tuple(np.array([r[n]]) for n in names), discounts)[0]), int(r[f"s{CUT}"])) for r in sums}


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row a document: key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    Null and empty texts are one end token; null keys and repeated rows pass through, each row learnt from and scored by
    itself; other columns are ignored, whatever their names; an empty table gives an empty result. Without any training
    document all words are unknown. The driver gets at most HOT words' counts and weights and a row of sums, whatever the
    input; words are told apart by 64-bit codes (a chance of n^2 / 2^65 of any mix-up among n).
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    words = written(count_training(source), "ngrams1")
    told = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words"), F.coalesce(F.sum(F.when(F.col("n") > CUT, F.col("n"))), F.lit(0)).alias("high"), F.coalesce(F.sum(F.when(F.col("code") == _END, F.col("n"))), F.lit(0)).alias("documents"), *[F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, CUT + 2)]).first()
    unigrams = Unigrams.of(told["tokens"], told["words"], [told[f"n{k}"] for k in range(1, CUT + 2)], told["high"], told["documents"])
    hot = {r["code"] % 2**64: r["n"] for r in words.where(F.col("n") * HOT > told["tokens"]).collect()}
    # a text's beginning is a history as frequent as its end is a word
    split = hot | ({_BEGIN: told["documents"]} if told["documents"] * HOT > told["tokens"] else {})
    buckets = max(1, -(-told["tokens"] // bucket_tokens))
    met = written(gather(count_words(send_tokens(source, buckets, split), buckets, split), unigrams, split), "ngrams2")
    sums = met.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(1, CUT + 2)]).first()
    discounts = Discounts.of([float(sums[f"n{k}"]) for k in range(1, CUT + 2)])
    weights = written(weigh(met, discounts, hot_histories(met, discounts, split, told["documents"])), "weights")
    factors, tokens = np.log10(discounts.factors), told["tokens"]

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        own = pa.ipc.open_stream(group["data"][group["kind"] == _SCORED].iloc[0]).read_all().to_pandas()
        score = own["score"].to_numpy() + sum(f * own[f"low{k}"].to_numpy() for k, f in enumerate(factors))
        for data in group["data"][group["kind"] != _SCORED]:
            at, adds = _unpacked(data)
            score[at] += adds
        return pd.DataFrame({"key": own["key"], "held_out": own["held"], "n_tokens": own["n"], "n_known": own["known"], "train_tokens": tokens, "base_score": own["base"], "score": score})

    rows = met.where(F.col("kind") == _SCORED).select("slice", "kind", "data").unionByName(weights.where("slice >= 0").select("slice", F.lit(0).alias("kind"), "data"))
    schema = f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.groupBy("slice").applyInPandas(finish, schema).withColumnRenamed("key", key)
