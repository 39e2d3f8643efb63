"""Whole-text encoding as the tokenizers library does it, each distinct piece of a slice of texts once.

Both vocabularies split text at white space before any merge, so a text's ids are the ids of its pieces in a row. Pieces
of plain Latin letters and marks are merged as arrays, all distinct ones of a slice together; every other piece (digits,
apostrophes, other scripts, very long ones) goes to the library. ``tests/llm`` holds the result against the library's
encoding of whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept in a worker's memory: about 200 bytes each.
CACHE_PIECES = 100_000
#: Longer pieces go to the library and are encoded each time, so that rounds of merges and the cache are bounded.
_LONGEST = 64

# White space as the tokenizers' patterns know it (Unicode White_Space); fixed values.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RE2_SPACES = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_RE2_RARE = _RE2_SPACES.replace("\\t-\\r ", "\\t\\v\\f\\r")
#: A run of white space and what follows up to the next one; or the text's last run.
_SPACED = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
#: Marks that the patterns keep together after letters: all of ASCII but the apostrophe (fixed values).
_MARKS = b"!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~-"

_OTHER, _LETTER, _MARK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[list(_MARKS)] = _MARK
#: Second bytes of the Latin letters U+00C0 to U+00FF, whose first byte is 0xC3 (not the signs for times and divided by).
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


class PieceCache(dict):
    """piece -> what ``encode`` gives for it; emptied when full."""

    def __init__(self, encode: Callable[[str], bytes], most: int = CACHE_PIECES):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= _LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    """The tokenizer of a file, with truncation and padding off."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def as_bytes(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class IntTable:
    """A fixed map of non-negative 64-bit numbers, looked up as arrays; ``none`` for what it doesn't hold."""

    _ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, entries: dict[int, int], none: int):
        self.none, self.bits = none, max(4, (4 * len(entries)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, none, np.int64)
        slots = self._slot(np.array(list(entries), dtype=np.int64)).tolist()
        for slot, (key, value) in zip(slots, entries.items(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (1 << self.bits) - 1
            self.keys[slot], self.values[slot] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self._ODD >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        slots = self._slot(asked)
        keys = self.keys[slots]
        out = np.where(keys == asked, self.values[slots], self.none)
        open_ = np.flatnonzero((keys != asked) & (keys >= 0))
        while len(open_):  # the next slots, for the few whose slot another key holds
            slots[open_] = (slots[open_] + 1) & (1 << self.bits) - 1
            keys = self.keys[slots[open_]]
            hit = keys == asked[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (keys >= 0)]
        return out


class MergeTable:
    """Ranked merges of pairs of ids, and the merging of many words at once."""

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int]):
        """``pairs`` in rank order; the pair of rank r becomes the id ``merged[r]``. A pair listed twice has its last rank, as in the library."""
        self.merged = np.array([*merged, 0], dtype=np.int64)
        self.none = len(merged)
        self.ranks = IntTable({a << 32 | b: rank for rank, (a, b) in enumerate(pairs)}, self.none)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` for pairs that don't merge."""
        return self.ranks(left << 32 | right)

    def merge(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, their numbers), from words given as first ids in a row and their numbers.

        In each round every word merges its pair of least rank, the first one of equals, as long as it has one. Ids are
        linked lists over their first places; a place's key is the rank of its pair, then the place.
        """
        n = len(ids)
        ids, begins = np.append(ids, 0), np.cumsum(lengths) - lengths
        following, preceding = np.arange(1, n + 2), np.arange(-1, n)
        ends = begins + lengths - 1
        following[ends], preceding[begins] = n, n  # place n stands for none
        keys = np.full(n + 1, self.none << 32, np.int64)

        def weigh(at: np.ndarray) -> None:
            right = following[at]
            inner = np.flatnonzero((at < n) & (right < n))
            at, right = at[inner], right[inner]
            keys[at] = self.rank(ids[at], ids[right]) << 32 | at

        weigh(np.flatnonzero(following[:n] < n))
        live, bounds = begins, np.stack([begins, ends + 1], axis=1).ravel()
        while len(live):
            least = np.minimum.reduceat(keys, bounds)[::2]
            on = least < self.none << 32
            if not on.all():
                least, live, bounds = least[on], live[on], bounds.reshape(-1, 2)[on].ravel()
            at = least & 0xFFFFFFFF
            gone = following[at]
            right = following[gone]
            ids[at], ids[gone], keys[at] = self.merged[least >> 32], -1, self.none << 32
            keys[gone] = self.none << 32
            following[at], preceding[right] = right, at
            weigh(np.concatenate([at, preceding[at]]))
        ids = ids[:n]
        stays = ids >= 0
        return ids[stays], np.add.reduceat(stays, begins, dtype=np.int64) if len(begins) else begins


class TextEncoder:
    """``encode_all(texts)``: the ids of whole texts.

    ``word_ends``: the vocabulary marks word ends, lower-cases and drops white space, so pieces are words; otherwise it
    is byte-level and a piece keeps the white space before it.
    """

    def __init__(self, path: str):
        self.tokenizer = library_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.word_ends = bool(suffix)
        vocabulary = model["vocab"]
        if max(vocabulary.values()) >= 1 << 31:
            raise ValueError("ids of more than 31 bits")
        pairs = [p if not isinstance(p, str) else p.split(" ") for p in model["merges"]]
        self.table = MergeTable([(vocabulary[a], vocabulary[b]) for a, b in pairs], [vocabulary[a + b] for a, b in pairs])
        letters = byte_letters()
        self.first = np.array([vocabulary[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocabulary[x + suffix] for x in letters], dtype=np.int64)
        self.pieces = PieceCache(self._piece)

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece that isn't plain."""
        return as_bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, their numbers) of plain pre-tokens, given as bytes in a row and their numbers."""
        ids, ends = self.first[data], np.cumsum(lengths) - 1
        ids[ends] = self.last[data[ends]]
        return self.table.merge(ids, lengths)

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of each text, null as empty."""
        texts = pc.fill_null(texts, "")
        if self.word_ends:
            return pc.ascii_split_whitespace(texts)
        odd = pc.match_substring_regex(texts, f"\x00|[{_RE2_SPACES}][{_RE2_SPACES}]|[{_RE2_RARE}]")
        lists = texts.filter(pc.invert(odd))
        for space in " \n":  # single spaces only: each starts a piece
            lists = pc.replace_substring(lists, space, f"\x00{space}")
        lists = pc.split_pattern(lists, "\x00")
        if not pc.any(odd).as_py():
            return lists
        runs = pa.array([_SPACED.findall(t) for t in texts.filter(odd).to_pylist()], lists.type)
        return pa.concat_arrays([lists, runs]).take(pa.array(np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"))))

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which pieces are plain, the ids of those in a row, and the number of ids of each piece, 0 if not plain)."""
        sizes = np.diff(offsets)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        begins = np.zeros(len(data), bool)
        begins[offsets[:-1][sizes > 0]] = True
        kinds = _CLASS[data]
        lead = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]] & ~begins[1:])
        kinds[lead] = kinds[lead + 1] = _LETTER
        opening = np.zeros(len(data), bool)  # a space or line end before the letters
        if not self.word_ends:
            opening = begins & ((data == 0x20) | (data == 0x0A))
        heads = begins.copy()  # the first byte after the opening
        heads[1:] |= opening[:-1] & ~begins[1:]
        heads &= ~opening
        before = np.concatenate([[_OTHER], kinds[:-1]])
        bad = (kinds == _OTHER) | heads & (kinds != _LETTER) | ~heads & (kinds == _LETTER) & (before == _MARK)
        bad &= ~opening
        plain = (sizes > 0) & (sizes <= _LONGEST)
        plain[piece[bad]] = False
        plain[piece[opening]] &= sizes[piece[opening]] > 1
        chosen = plain[piece]
        # pre-tokens: letters (with a space before them), marks; a line end is one of its own
        starts = begins | (kinds == _MARK) & (before == _LETTER)
        starts[1:] |= opening[:-1] & (data[:-1] == 0x0A)
        data, starts, owner = data[chosen], starts[chosen], piece[chosen]
        if self.word_ends:
            capital = (data >= 0x41) & (data <= 0x5A)
            follows = np.concatenate([[False], data[:-1] == 0xC3]) & (data >= 0x80) & (data <= 0x9E)
            data = data + (capital | follows) * np.uint8(0x20)
        at = np.flatnonzero(starts)
        ids, counts = self._words(data, np.diff(at, append=len(data)))
        return plain, ids, np.bincount(owner[at], weights=counts, minlength=len(sizes)).astype(np.int64)

    def _distinct(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, their numbers)."""
        if not len(pieces):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, offsets, data = pieces.buffers()
        offsets = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        plain, ids, lengths = self._plain(data, offsets - offsets[0])
        rest = np.flatnonzero(~plain)
        found = [self.pieces[p] for p in pieces.take(pa.array(rest)).to_pylist()]
        lengths[rest] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        out = np.empty(int(lengths.sum()), np.int64)
        chosen = np.repeat(plain, lengths)
        out[chosen] = ids
        out[~chosen] = np.frombuffer(b"".join(found), dtype="<u4")
        return out, lengths

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text in them: one more than there are texts)."""
        lists = self._split(texts.cast(pa.string()))
        coded = lists.flatten().dictionary_encode()
        values, lengths = self._distinct(coded.dictionary)
        values = values.astype("<u4")
        first = np.concatenate([[0], np.cumsum(lengths)])
        at = coded.indices.to_numpy(zero_copy_only=False)
        each = lengths[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = values[np.repeat(first[at] - ends[:-1], each) + np.arange(ends[-1])]
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return ids, ends[offsets]

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit bytes; null is empty."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter of each byte value in byte-level vocabularies: itself if printable, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    letters = {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    """The worker's own encoder of a vocabulary file, with its cache."""
    return TextEncoder(path)
