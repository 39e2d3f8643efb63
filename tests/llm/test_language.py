"""Language identification against a plain parse, and its accuracy on held-out documents."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from locusframe.llm import language
from locusframe.llm.common import table


def plain_phrases(text, sample):
    at = count = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, count = at + size, count + 1
    return count


def folded(text):
    data, owner, _ = language._bytes(pa.array([text]))
    return language.folded(data, owner)[0].tobytes()


def test_folding():
    assert folded("  Él,  ÀB-c9d!\n") == "él àb c d".encode()
    assert folded(None) == folded("") == folded(" 12 !") == b""
    assert folded("×÷ 中文") == "×÷ 中文".encode()


@pytest.mark.parametrize("piece", [1, 3, 50, 1 << 13])
def test_phrases_are_those_of_the_longest_match_parse(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    rng = random.Random(4)
    word = lambda letters, n: bytes(rng.choice(letters) for _ in range(n))
    samples = [word(b"abc", 300), word(b"abd ", 200), b"", b"a"]
    parser = language.CrossParser(["w", "x", "y", "z"], samples)
    texts = [word(b"abcd e", rng.randint(0, 120)) for _ in range(60)] + [samples[0] * 3, b"", b"\xff"]
    got = parser.phrases(np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts))))
    assert got.tolist() == [[plain_phrases(t, s) for s in samples] for t in texts]


def test_language_of_every_document(spark, small):
    docs = table(spark, small, "documents")
    rows = language.identify(spark, docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held) and len(held) > 40


def test_awkward_rows(spark):
    schema = "doc_id bigint, text string, lang string, language string, number string"
    rows = [(i, t, g, "x", "y") for i, (t, g) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("le chat est sur la table", None), (None, "en"), ("", "de"), ("12 3!", "de"), ("中文", ""), ("the dog " * 30_000, "en")] * 4)]
    rows += [rows[0], (None, "the cat", "en", None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = language.identify(spark, docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id] or "")))
            assert r.score == 0 or r.lang_pred in ("en", "de", "")
            assert r.lang_pred == "en" or not (texts[r.doc_id] or "").startswith("the ")
    assert language.identify(spark, docs.limit(0)).count() == 0
    assert {(r.lang_pred, r.score) for r in language.identify(spark, docs.drop("lang").selectExpr("*", "string(null) lang")).collect()} == {("und", 0.0)}


def test_sample_is_bounded_and_does_not_depend_on_the_order(spark, small):
    docs = table(spark, small, "documents")
    take = lambda df: sorted(language.sampled_windows(df, "lang", "text", "doc_id", 5, 40).collect())
    found = take(docs)
    assert found == take(docs.repartition(7, "source")) and {r.language for r in found} == {r.lang for r in docs.select("lang").distinct().collect()}
    assert all(sum(r.language == x for r in found) <= 5 for x in {r.language for r in found}) and all(len(r.piece) <= 40 for r in found)
