"""Words that are cut and hashed as arrays, against a version word by word."""

import random

import xxhash

from locusframe.llm import substring_dedup

BITS = [b" ", b"\n", b"\t", b"\x0b", b"\x0c", b"\r", b".", b"!", b"?", b"A", b"b", b"\xc3\x84", b"\xc2\xa0", b"\x00", b"\x1c", b"longer", b"q" * 31, b"Q" * 32, b"w.Z" * 30]


def odd_texts(rng):
    some = lambda: b"".join(rng.choice(BITS) for _ in range(rng.randrange(rng.choice([4, 30, 300]))))
    return [rng.choice([None, b"", b" \n"]) if rng.random() < 0.3 else some() for _ in range(rng.randrange(6))]


def test_words_one_by_one():
    rng = random.Random(6)
    hashed = lambda w: xxhash.xxh64_intdigest(w.translate(substring_dedup._LOWER)) & ~1 | w.endswith((b".", b"!", b"?"))
    for _ in range(400):
        texts = odd_texts(rng)
        words = [w for t in texts for w in (t or b"").split()]
        found = substring_dedup.Words(texts)
        assert found.codes().tolist() == [hashed(w) for w in words] and found.n == len(words)
        counts = [len((t or b"").split()) for t in texts]
        assert found.first.tolist() == [sum(counts[:i]) for i in range(len(texts))]
        lines = [len(line.split()) for t in texts for line in (t or b"").split(b"\n")]
        assert found.line_ends().tolist() == [sum(lines[: i + 1]) - 1 for i, n in enumerate(lines) if n]
    for n in range(1, 80):
        word = rng.randbytes(n).translate(bytes(range(256)), b" \t\n\v\f\r") or b"x"
        assert substring_dedup.Words([word]).codes().tolist() == [hashed(word)]


def test_no_call_a_word(monkeypatch):
    calls = []
    monkeypatch.setattr(substring_dedup.xxhash, "xxh64_intdigest", lambda word: calls.append(word) or 2)
    text = " ".join(f"new{i}" for i in range(5000)).encode()
    substring_dedup.Paragraphs([text, b"one " + b"l" * 32]).names()
    substring_dedup.Windows([text])
    assert len(calls) == 1


def test_cuts_need_no_hashes(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_LOWER_CASE", None)
    assert substring_dedup.cut_passages(b"A b.\nC d e.\nF", {1}) == "A b.\nF"
