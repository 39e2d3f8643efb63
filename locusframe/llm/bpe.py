"""Operator 5: byte-pair encoding by dynamic programming over prefixes, and its decoding.

The ids of every prefix of a word end in one token only. That token is found from the vocabulary tokens that are
suffixes of the prefix (an automaton over the vocabulary gives them as the word is read): it is the one that may
stand after the last token of what precedes it, that is, whose pair with that token no merge would break up. Back
pointers from the word's end give the exact ids, in time linear in the word, without running the merges. The distinct
plain words of a slice go through the programme together, place by place, as arrays; others one by one.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import text_slices
from locusframe.llm.token_cache import IntTable, MergeTable, TextEncoder, as_bytes, byte_letters

_ID_BITS = 20
_END = "\ue000"  # stands for the end-of-word suffix; no byte is written as it


class PrefixEncoder:
    """Encodes single pre-tokens with a vocabulary and its ranked merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str = ""):
        if max(vocabulary.values()) >= 1 << _ID_BITS:
            raise ValueError(f"ids of more than {_ID_BITS} bits")
        self.suffix = suffix
        self.names = {i: t for t, i in vocabulary.items()}
        inner = (lambda t: t[: -len(suffix)] + _END if suffix and t.endswith(suffix) and t != suffix else t)
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if not isinstance(pair, str) else pair.split(" ")
            token = vocabulary[left + right]
            self.pairs.setdefault((vocabulary[left], vocabulary[right]), rank)
            if token not in self.rank:
                self.rank[token], self.halves[token] = rank, (vocabulary[left], vocabulary[right])
        self.automaton = ahocorasick.Automaton()
        for token, number in vocabulary.items():
            word = inner(token)
            if len(word) - word.endswith(_END) == 1 or number in self.rank:  # one letter, or reachable by merges
                self.automaton.add_word(word, (number, len(word)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their joined text is merged.

        Their last merges are undone, newest first. A merge across the border would have happened if its rank comes
        before that of the merge undone last; at equal rank the one further left comes first.
        """
        known = self.fits.get(code := left << _ID_BITS | right)
        if known is not None:
            return known
        limit, ok = float("inf"), True
        while True:
            if self.pairs.get((left, right), limit) < limit:
                ok = False
                break
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a > b:
                limit, left = a, self.halves[left][1]
            elif b >= 0:
                limit, right = b + 0.5, self.halves[right][0]
            else:
                break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[code] = ok
        return ok

    def encode(self, letters: str) -> list[int]:
        """The ids of one pre-token, given in byte letters."""
        if self.suffix:
            letters += _END
        last, back, fits = [-1] * len(letters), [0] * len(letters), self.fits
        for end, (token, length) in self.automaton.iter(letters):
            if last[end] >= 0:
                continue
            if (start := end - length) >= 0:  # the place before the token
                before = last[start]
                if before < 0:
                    continue
                fit = fits.get(before << _ID_BITS | token)
                if not (self.compatible(before, token) if fit is None else fit):
                    continue
            last[end], back[end] = token, length
        ids, end = [], len(letters) - 1
        while end >= 0:
            if last[end] < 0:
                raise ValueError(f"no tokens for {letters!r}")
            ids.append(last[end])
            end -= back[end]
        return ids[::-1]


class PrefixProgramme:
    """The same programme for many words at once, in arrays; a word is its bytes and an end mark where tokens mark word ends."""

    _MARK = 256
    _SLOTS = 20  # bits of the number of remembered pairs

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        code = {letter: value for value, letter in enumerate(byte_letters())}
        pairs = [p if not isinstance(p, str) else p.split(" ") for p in merges]
        self.table = MergeTable([(vocabulary[a], vocabulary[b]) for a, b in pairs], [vocabulary[a + b] for a, b in pairs])
        most = max(vocabulary.values()) + 1
        self.mark, self.length, self.shorter = bool(suffix), np.zeros(most, np.int64), np.full(most, -1, np.int64)
        self.rank, self.left, self.right = (np.full(most, -1, np.int64) for _ in range(3))
        for rank, (a, b) in enumerate(pairs):
            if self.rank[token := vocabulary[a + b]] < 0:
                self.rank[token], self.left[token], self.right[token] = rank, vocabulary[a], vocabulary[b]
        # the trie of all tokens that stand for one letter or that merges reach
        steps: dict[int, int] = {}
        fall, longest, depth_first = [0], [-1], [[(0, 0, 0)]]
        for token, number in vocabulary.items():
            ended = suffix and token.endswith(suffix) and token != suffix
            word = [code.get(x, -1) for x in (token[: -len(suffix)] if ended else token)]
            if min(word, default=-1) < 0 or len(word) > 1 and self.rank[number] < 0:
                continue
            word += [self._MARK] * bool(ended)
            node = 0
            for depth, letter in enumerate(word, 1):
                if (after := steps.get(node << 9 | letter)) is None:
                    after = steps[node << 9 | letter] = len(fall)
                    fall.append(0)
                    longest.append(-1)
                    if depth == len(depth_first):
                        depth_first.append([])
                    depth_first[depth].append((after, node, letter))
                node = after
            longest[node], self.length[number] = number, len(word)
        for level in depth_first[1:]:
            for node, above, letter in level:
                if above:
                    at = fall[above]
                    while at and at << 9 | letter not in steps:
                        at = fall[at]
                    fall[node] = steps.get(at << 9 | letter, 0)
                if longest[node] >= 0:
                    self.shorter[longest[node]] = longest[fall[node]]
                else:
                    longest[node] = longest[fall[node]]
        self.steps, self.fall, self.longest = IntTable(steps, -1), np.array(fall), np.array(longest)
        self.known = np.full(1 << self._SLOTS, -1, np.int64)

    def _read(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The automaton's next nodes."""
        after = self.steps(node << 9 | letter)
        open_ = np.flatnonzero(after < 0)
        node = node[open_]
        while len(open_):
            root = node == 0
            after[open_[root]] = 0
            open_, node = open_[~root], self.fall[node[~root]]
            found = self.steps(node << 9 | letter[open_])
            after[open_] = found
            open_, node = open_[found < 0], node[found < 0]
        return after

    def _judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``PrefixEncoder.compatible`` of many pairs; limits are doubled ranks."""
        ok, at = np.ones(len(left), bool), np.arange(len(left))
        limit = np.full(len(left), 2 * self.table.none, np.int64)
        while len(at):
            broken = 2 * self.table.rank(left, right) < limit
            ok[at[broken]] = False
            a, b = self.rank[left], self.rank[right]
            on = ~broken & (np.maximum(a, b) >= 0)
            at, left, right, a, b = at[on], left[on], right[on], a[on], b[on]
            first = a > b
            limit = np.where(first, 2 * a, 2 * b + 1)
            left, right = np.where(first, self.right[left], left), np.where(first, right, self.left[right])
        return ok

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs may stand together; pairs met last are remembered by a table of fixed size."""
        code = left << _ID_BITS | right
        slot = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._SLOTS)).astype(np.int64)
        held = self.known[slot]
        ok = held & 1 == 1
        new = np.flatnonzero(held >> 1 != code)
        if len(new):
            ok[new] = self._judge(left[new], right[new])
            self.known[slot[new]] = code[new] << 1 | ok[new]
        return ok

    def words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, their numbers), from words given as bytes in a row and their numbers."""
        if not len(lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = lengths + self.mark
        begins = np.cumsum(size) - size
        letters = np.full(int(size.sum()), self._MARK, np.int64)
        letters[np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(data))] = data
        last = np.full(len(letters), -1, np.int64)
        order = np.argsort(-size, kind="stable")
        begin, node = begins[order], np.zeros(len(order), np.int64)
        counts = len(size) - np.searchsorted(np.sort(size), np.arange(size.max()), side="right")
        for place, count in enumerate(counts.tolist()):
            at = begin[:count] + place
            node[:count] = self._read(node[:count], letters[at])
            token = self.longest[node[:count]]
            at = at[token >= 0]
            start, token = at - place, token[token >= 0]
            while len(at):
                before = at - self.length[token]
                ok = before < start  # the token is the whole prefix
                inner = np.flatnonzero(~ok)
                previous = last[before[inner]]
                inner, previous = inner[previous >= 0], previous[previous >= 0]
                ok[inner] = self.compatible(previous, token[inner])
                last[at[ok]] = token[ok]
                token = self.shorter[token]
                on = ~ok & (token >= 0)
                at, start, token = at[on], start[on], token[on]
        # back pointers: each token stands at its last place
        final, at, start = np.full(len(letters), -1, np.int64), begins + size - 1, begins
        while len(at):
            token = last[at]
            if (token < 0).any():
                raise ValueError("no tokens for a word")
            final[at] = token
            at = at - self.length[token]
            at, start = at[at >= start], start[at >= start]
        stays = final >= 0
        return final[stays], np.add.reduceat(stays, begins, dtype=np.int64)


class WordBpe(TextEncoder):
    """Whole texts with a tokenizer file of the word-end kind: NFC, white space, lower case, pattern, byte letters.

    Everything is read from the file; other normalisers, patterns or decoders than those below are refused. The library
    is not asked.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        steps = [n["type"] for n in told["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or told["decoder"] or model["continuing_subword_prefix"] or not model["end_of_word_suffix"]:
            raise ValueError("a tokenizer of another kind")
        super().__init__(path)
        self.core = PrefixEncoder(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.programme = PrefixProgramme(model["vocab"], model["merges"], model["end_of_word_suffix"])
        names = self.core.names | {t["id"]: t["content"] for t in told["added_tokens"]}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)])
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()

    def _words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.programme.words(data, lengths)

    def _piece(self, piece: str) -> bytes:
        """The ids of what stands between two white-space characters, if it isn't plain."""
        ids: list[int] = []
        for part in self.at_added.split(piece) if self.at_added else [piece]:
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                for word in self.pattern.findall(lowered(unicodedata.normalize("NFC", part))):
                    ids += self.core.encode("".join([self.letters[b] for b in word.encode()]))
        return as_bytes(ids)

    def decode(self, ids) -> str:
        """The tokens' own texts, a space between two of them: what the file's decoder (none) gives."""
        return " ".join(self.names.take(pa.array(np.asarray(ids, dtype=np.int64))).to_pylist())

    def round_trips(self, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """(ids, decoded text in UTF-8) of each text."""
        ids, at = self.encode_all(texts)
        lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), self.names.take(pa.array(ids)))
        decoded = pc.binary_join(lists, " ").cast(pa.binary())
        for a, b, text in zip(at.tolist(), at[1:].tolist(), decoded, strict=False):
            yield ids[a:b].tobytes(), text.as_py()


def lowered(text: str) -> str:
    """Lower case as the tokenizers do it, one character at a time (no final-sigma rule)."""
    return text.lower() if "Σ" not in text else "".join([c.lower() for c in text])


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """The worker's own encoder of a vocabulary file, with its caches."""
    return WordBpe(path)


def bpe_round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """One row a document: key, n_tokens, ids_sha256, decoded_sha256 and (``full``) ids and decoded text.

    Null and empty texts have no ids; null keys and repeated rows pass through; other columns are ignored. One pass
    without a shuffle; memory is one text and the bounded caches.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            rows = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if full else {})
            for ids, decoded in word_bpe(vocabulary).round_trips(batch.column(1)):
                rows["n_tokens"].append(len(ids) // 4)
                rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if full:
                    rows["ids"].append(np.frombuffer(ids, "<u4").astype(np.int64))
                    rows["decoded"].append(decoded.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.values())], ["key", *rows])

    more = ", ids array<bigint>, decoded string" if full else ""
    return source.mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("key", key)
