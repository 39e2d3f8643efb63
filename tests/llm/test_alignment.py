"""Token alignment against a plain version."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from locusframe.llm import alignment
from locusframe.llm.common import table
from locusframe.llm.queries import vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(vocabulary(A))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=vocabulary(B)), {c: i for i, c in enumerate(alignment.byte_letters())}


def plain_groups(text, libraries):
    """[([a ids], [b ids])] of each group, by walking over the bytes' ends."""
    if not text:
        return []
    first, second, code = libraries
    a = [(i, bytes(code[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes.fromhex(piece[3:5]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()))
    if {b"".join(x for _, x in a), b"".join(x for _, x in b)} != {(" " + text).encode()}:
        return []
    ends = [list(np.cumsum([len(x) for _, x in side])) for side in (a, b)]
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append(([x for x, _ in a[i:k]], [x for x, _ in b[j:m]]))
        i, j = k, m
    return out


def plain(rows, libraries):
    groups = [plain_groups(t, libraries) for _, t in rows]
    count = collections.Counter(p for own in groups for p in {(x, y) for a, b in own for x in a for y in b})
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (key, _), own in zip(rows, groups, strict=True):
        links = [(x, y) for a, b in own for x in a for y in b]
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append((key, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return out


ODD = ["", None, "a", " ", "  a  b ", "x\ty\r\n\nz", "▁ mark", "say <|endoftext|> and <s> </s>", "é́ ﬁ ½ 中文字 😀😀 \U0001f9ff", "a\x00b", "aaaa" * 700, "中" * 300, "don't 12345 --- ....", "word " * 5000, "A's　B\xa0C", "ab" * 5 + "\x85" + " "]


@pytest.mark.parametrize("limits", [(256, 1_500_000, 8_000_000, 1 << 21, 256), (3, 200, 2000, 4, 2)])
def test_alignment(spark, small, libraries, monkeypatch, limits):
    for name, value in zip(("WORK", "BYTES", "SLICE", "_LINKS", "_LARGE"), limits, strict=True):
        monkeypatch.setattr(alignment, name, value)
    monkeypatch.setattr(alignment.overlaps, "__defaults__", (limits[0],))
    rows = [(i, t, "s", 1) for i, t in enumerate(ODD)] + [(3, "a", "s", 2), (None, "one word", None, None), (None, None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, slice string, code int")
    for df in (odd, table(spark, small, "documents").where("n_chars < 6000")) if limits[0] > 3 else (odd,):
        want = plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], libraries)
        got = alignment.align_tokenizers(df, vocabulary(A), vocabulary(B), groups=True).collect()
        assert collections.Counter(tuple(r)[:8] for r in got) == collections.Counter(want)
        assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in got)
    assert alignment.align_tokenizers(odd.limit(0), vocabulary(A), vocabulary(B)).count() == 0


def test_merge_path_pieces_give_the_groups_of_one_merge():
    rng = random.Random(5)
    for _ in range(200):
        end = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, end + 1), rng.randint(0, end)), end})) for _ in range(2))
        both = np.intersect1d(a, b)
        for work in (1, 2, 5, 64):
            of_a, of_b, n = alignment.overlaps(a, b, work)
            assert of_a.tolist() == np.searchsorted(both, a).tolist() and of_b.tolist() == np.searchsorted(both, b).tolist() and n == len(both)
            cut = alignment.diagonals(a, b, work)
            assert [len(x) for x in np.split(np.arange(len(a) + len(b)), range(work, len(a) + len(b), work))] and cut[0] == 0 and cut[-1] == len(a)
