"""Operator 13: language identification by cross-parsing entropy.

Each language has the suffix automaton of a bounded sample of its labelled text. A text is parsed against it from left
to right: a phrase is the longest match from where the last one ended. The fewer phrases a text needs, the better the
language tells it; phrases count for log2 of the sample's length, so a language with less sample isn't favoured. A
suffix automaton read from its root knows all substrings, so a parse is one table look-up a letter: where no step goes
on, a phrase ends and the letter is read from the root. All texts of a slice and all languages are read at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import broadcast_if_small, shared_path, text_slices, written
from locusframe.llm.shared_files import opened, whole_file

#: What is learned of a language at most: windows of so many letters, one a document.
WINDOWS, WINDOW = 150, 400
#: Longer texts are read in pieces of so many bytes at once, whose borders are mended afterwards.
PIECE = 1 << 13
_SPACE = 0x20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:0x80] = [b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A else _SPACE for b in range(0x80)]
_FLAG = 1 << 30


def folded(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes as the parse reads them, and the texts they belong to.

    ASCII and Latin-1 letters are in lower case, all other ASCII is white space, of which one byte stays between two
    letters and none at a text's ends; other bytes stay.
    """
    upper = np.concatenate([[False], data[:-1] == 0xC3]) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out = _FOLD[data] + upper * np.uint8(0x20)
    space, first = out == _SPACE, np.concatenate([[True], owner[1:] != owner[:-1]])
    stays = ~(space & (np.concatenate([[True], space[:-1]]) | first))
    out, owner = out[stays], owner[stays]
    last = np.concatenate([owner[1:] != owner[:-1], [True]])[: len(out)]
    stays = ~(last & (out == _SPACE))
    return out[stays], owner[stays]


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The steps of each state of the suffix automaton of ``data``; state 0 is the root."""
    steps, link, length, last = [{}], [-1], [0], 0
    for letter in data:
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and letter not in steps[at]:
            steps[at][letter] = new
            at = link[at]
        if at >= 0:
            to = steps[at][letter]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(steps)
                steps.append(dict(steps[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                link[to] = link[new] = copy
                while at >= 0 and steps[at].get(letter) == to:
                    steps[at][letter] = copy
                    at = link[at]
        last = new
    return steps


class CrossParser:
    """The automata of all languages in one table: row = state, column = class of the byte read."""

    def __init__(self, languages: list[str], samples: list[bytes]):
        self.languages = languages
        self.weight = np.log2(np.maximum([len(s) for s in samples], 2))
        used = sorted(set(b"".join(samples)))
        self.classes = np.zeros(256, np.int32)  # class 0: bytes that no sample has
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        automata = [suffix_automaton(s) for s in samples]
        self.roots = np.concatenate([[0], np.cumsum([len(a) for a in automata])])[:-1].astype(np.int32)
        if sum(map(len, automata)) * self.width >= _FLAG:
            raise ValueError("samples too large: take fewer or shorter windows")
        # a cell holds the next state's row start; _FLAG marks letters that begin a phrase: those read at the root, and those
        # that a state has no step for, which are read from the root
        self.steps = np.empty((sum(map(len, automata)), self.width), np.int32)
        for root, automaton in zip(self.roots.tolist(), automata, strict=True):
            rows = slice(root, root + len(automaton))
            again = np.full(self.width, root * self.width | _FLAG, np.int32)
            for letter, to in automaton[0].items():
                again[self.classes[letter]] = (root + to) * self.width | _FLAG
            self.steps[rows] = again
            cells = [(root + i, self.classes[letter], (root + to) * self.width) for i, own in enumerate(automaton) if i for letter, to in own.items()]
            at = np.array(cells, dtype=np.int64).reshape(-1, 3)
            self.steps[at[:, 0], at[:, 1]] = at[:, 2]
        self.flat = self.steps.ravel()

    def _read(self, letters: np.ndarray, begins: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases begun, last states) of pieces [begins, begins + sizes) of ``letters``, read side by side from ``states``."""
        order = np.argsort(-sizes, kind="stable")
        at, state, begun = begins[order], states[order].astype(np.int32), np.zeros(len(order), np.int32)
        live = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
        for place, n in enumerate(live.tolist()):
            cell = self.flat[state[:n] + letters[at[:n] + place]]
            begun[:n] += cell >> 30
            state[:n] = cell & (_FLAG - 1)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return begun[back], state[back]

    def phrases(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns), from folded bytes in a row and their numbers."""
        kinds, letters = len(self.languages), self.classes[data]
        pieces = -(-lengths // PIECE)
        text = np.repeat(np.arange(len(lengths)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins = (np.cumsum(lengths) - lengths)[text] + number * PIECE
        sizes = np.minimum(lengths[text] - number * PIECE, PIECE)
        roots = self.roots.astype(np.int64) * self.width
        # lanes: all pieces in the first language, then in the second, and so on
        lane_begin, lane_size, first = np.tile(begins, kinds), np.tile(sizes, kinds), np.tile(number == 0, kinds)
        entry = np.repeat(roots, len(text)).astype(np.int32)
        begun, state = self._read(letters, lane_begin, lane_size, entry)
        todo = np.flatnonzero(~first)
        while len(todo):  # a piece that another state than the root enters is read again, until no entry changes
            todo = todo[entry[todo] != state[todo - 1]]
            if len(todo):
                entry[todo] = state[todo - 1]
                begun[todo], state[todo] = self._read(letters, lane_begin[todo], lane_size[todo], entry[todo])
                todo = todo + 1
                todo = todo[todo < len(first)]
                todo = todo[~first[todo]]
        sums = np.bincount(np.tile(text, kinds) + np.repeat(np.arange(kinds) * len(lengths), len(text)), weights=begun, minlength=kinds * len(lengths))
        return sums.reshape(kinds, len(lengths)).T

    def judge(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """(language, score) of each text; null texts and texts without a letter are ``und`` with score 0."""
        data, owner, count = _bytes(texts)
        folded_data, folded_owner = folded(data, owner)
        lengths = np.bincount(folded_owner, minlength=count).astype(np.int64)
        if not self.languages:
            return ["und"] * count, [0.0] * count
        cost = self.phrases(folded_data, lengths) * self.weight
        best = cost.argmin(axis=1)
        least = cost[np.arange(count), best]
        cost[np.arange(count), best] = np.inf
        rival = cost.min(axis=1)
        score = np.where(np.isfinite(rival), 1 - least / np.maximum(rival, 1e-300), 1.0) if count else least
        lettered = np.zeros(count, bool)
        lettered[owner[(_FOLD[data] != _SPACE) & (data < 0x80)]] = True
        for i in np.flatnonzero(~lettered & (lengths > 0)).tolist():  # no ASCII letter: is there any other
            lettered[i] = any(map(str.isalpha, texts[i].as_py()))
        names = [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, np.where(lettered, np.clip(score, 0, 1), 0.0).tolist()


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """All UTF-8 bytes in a row, the number of the text each belongs to, and the number of texts; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, np.repeat(np.arange(len(texts)), np.diff(offsets)), len(texts)


def sampled_windows(labelled: DataFrame, language: str, text: str, key: str, windows: int, window: int) -> DataFrame:
    """(language, number, piece): up to ``windows`` windows of ``window`` letters a language, one a document.

    Documents with a letter and a language are counted first; of about four times as many as are needed, told by the hash
    of key and text, those with the least hashes give a window at a place that the hash decides. So every task sends a
    bounded number of narrow rows whatever the table's size.
    """
    code = F.xxhash64(F.col(key).cast("string"), F.col(text))
    start = (1 + F.pmod(code, F.greatest(F.length(text) - window, F.lit(0)).cast("long") + 1)).cast("int")
    rows = labelled.where(F.col(language).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(language).cast("string").alias("language"), code.alias("code"), F.substring(F.col(text), start, F.lit(window)).alias("piece")
    )
    share = written(rows.groupBy("language").agg((F.lit(4.0 * windows) / F.count("*")).alias("share")), "languages")
    uniform = F.col("code").cast("double") / 2.0**64 + 0.5
    chosen = rows.join(broadcast_if_small(share, 10_000), "language").where(uniform <= F.col("share"))
    numbered = chosen.withColumn("number", F.row_number().over(Window.partitionBy("language").orderBy("code", "piece")))
    return numbered.where(F.col("number") <= windows).select("language", "number", "piece")


def learn(spark: SparkSession, labelled: DataFrame, language: str = "lang", text: str = "text", key: str = "doc_id", windows: int = WINDOWS, window: int = WINDOW) -> str:
    """The folder of the samples of all languages: one file each, from at most ``windows`` x ``window`` letters.

    Rows without language or letters teach nothing; an empty table gives an empty folder.
    """
    folder = shared_path(spark, "languages")
    samples = sampled_windows(labelled, language, text, key, windows, window)

    def save(language: tuple, table: pa.Table) -> pa.Table:
        """One language: at most ``windows`` rows."""
        pieces = table.sort_by("number").column("piece").combine_chunks()
        data, owner = folded(*_bytes(pieces)[:2])
        sample = b" ".join(data[owner == i].tobytes() for i in range(len(pieces)))
        name = language[0].as_py()
        with whole_file(f"{folder}/{name.encode().hex() or '_'}") as out:
            out.write(sample)
        return pa.table({"language": [name], "bytes": [len(sample)]})

    samples.groupBy("language").applyInArrow(save, "language string, bytes bigint").agg(F.sum("bytes")).collect()  # one row
    return folder


@lru_cache(maxsize=2)
def parser_of(folder: str) -> CrossParser:
    """The worker's own automata, built from the samples of ``folder``."""
    from pyarrow import fs

    system, path = opened(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    files = {bytes.fromhex(f.base_name.strip("_")).decode(): f.path for f in found if not f.base_name.startswith(".")}
    samples = []
    for name in sorted(files):
        with system.open_input_stream(files[name]) as file:
            samples.append(file.read())
    return CrossParser(sorted(files), samples)


def predict(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """One row a document: key, the columns of ``more``, lang_pred and score, by the samples of ``folder``.

    Score is 1 - (cost in the best language / cost in the next), 1 where one language only was learned. Equal costs go to
    the language that comes first in order. Null texts and texts without a letter are ``und`` with score 0, as is all where
    nothing was learned. Null keys and repeated rows pass through. One pass without a shuffle.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *[c.alias(n) for n, c in (more or {}).items()])
    kept = [f for f in source.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            names, scores = parser_of(folder).judge(batch.column(1))
            own = [c for i, c in enumerate(batch.columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*[f.name for f in kept], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return source.mapInArrow(run, f"{schema}, lang_pred string, score double").withColumnRenamed("key", key)


def identify(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """Every document's language, learned from those whose crc32(key as text) mod ``folds`` isn't ``held``.

    Returns key, held_out, lang_pred, score. A null key counts as the text 'null'. The labels of held-out documents aren't
    read, and labels are no inputs of any prediction.
    """
    out = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), F.lit(folds)) == held
    folder = learn(spark, docs.where(~out), language, text, key)
    return predict(docs, folder, key, text, {"held_out": out}).select(key, "held_out", "lang_pred", "score")
