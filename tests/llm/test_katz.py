"""The Katz model against a version in plain dictionaries, and its sums."""

import collections
import math
import re
import zlib

import pytest

from locusframe.llm import katz
from locusframe.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [katz._END]
    before = [katz._BEGIN, *words[:-1]]
    return list(zip(before, words, strict=True))


def discounts(counts):
    n = [sum(v == r for v in counts) for r in range(1, 7)]
    out = {}
    common = 6 * n[5] / n[0] if n[0] else 1
    for r in range(1, 6):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common < 1 else 1
        out[r] = d if 0 < d <= 1 else 1
    return lambda r: out.get(r, 1)


def brute(rows):
    train = [x for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1 for x in tokens(t)]
    words, pairs, classes = (collections.Counter(x) for x in ([w for _, w in train], train, [h for h, _ in train]))
    n = len(train)
    d1, d2 = discounts(words.values()), discounts(pairs.values())
    seen = sum(d1(c) * c for c in words.values()) / n if n else 0
    unknown = max(1 - seen, 1 / (n + 1))
    p1 = lambda w: (1 - unknown) / seen * d1(words[w]) * words[w] / n if words[w] else unknown
    by = collections.defaultdict(list)
    for h, w in pairs:
        by[h].append(w)
    weight = {h: (1 - sum(d2(pairs[h, w]) * pairs[h, w] for w in ws) / (classes[h] + 1)) / (1 - sum(map(p1, ws))) for h, ws in by.items()}

    def p(h, w):
        r = pairs[h, w]
        return d2(r) * r / (classes[h] + 1) if r else weight.get(h, 1) * p1(w)

    out = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (len(words) + 1))) for _, w in own)
        out.append((i, zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1, len(own), sum(words[w] > 0 for _, w in own), n, base, sum(math.log10(p(h, w)) for h, w in own)))
    return out, p, words, weight


@pytest.mark.parametrize("hot", [50, 4096])
def test_scores(spark, small, hot, monkeypatch):
    monkeypatch.setattr(katz, "HOT", hot)
    docs = table(spark, small, "documents")
    odd = spark.createDataFrame([(0, None, "k"), (1, "", "k"), (2, "a B a b", "k"), (2, "a B a b", "k"), (None, "a b", "k"), (7, "x", "k"), (9, " a\x85b ", "k")], "doc_id bigint, text string, `key` string")
    for df in (docs, odd):
        want, p, words, weight = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        order = lambda x: (x[0] is not None, x[0] or 0)
        got = sorted([tuple(r) for r in katz.score_documents(df, bucket_tokens=5000).collect()], key=order)
        for a, b in zip(got, sorted(want, key=order), strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
        for h in [*list(weight)[:3], katz._BEGIN, -1]:  # every history's probabilities sum to one over the words and one unknown
            assert sum(p(h, w) for w in [*words, "never seen"]) == pytest.approx(1)
    assert katz.score_documents(odd.limit(0)).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(20) if katz.held_out(i)], "doc_id bigint, text string")
    assert all(r.n_known == 0 and r.score <= 0 for r in katz.score_documents(only).collect())


def test_held_out_text_is_likelier_than_under_single_words(spark):
    rows = katz.score_documents(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
