"""The pipeline's stages against brute force, each on what its predecessor kept."""

import collections
import itertools
import re
import zlib

import numpy as np

import corpus_pipeline
from locusframe.llm import substring_dedup
from locusframe.llm.common import table
from locusframe.llm.queries import vocabulary
from locusframe.llm.token_cache import library_tokenizer
from tests.llm.test_operators import brute_measures, brute_passages, brute_print, components_of


def windows(text, n=substring_dedup.LEAST_RUN):
    words = [w.translate(substring_dedup._LOWER) for w in (text or "").encode().split()]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def check_passages(before, after):
    """Texts only lose words, no window of over 50 words stands in two of them, and texts that share nothing stay as they are."""
    places = collections.Counter(w for t in after.values() for w in windows(t))
    assert not [w for w, n in places.items() if n > 1]
    units, pairs = brute_passages(list(before.items()))
    strong = components_of(units, [(a, b) for a, b, j in pairs if j >= 0.8])
    repeats = {c for c, n in collections.Counter(strong.values()).items() if n > 1}
    shared = {u[0] for u, c in strong.items() if c in repeats}
    seen = collections.Counter(w for t in before.values() for w in windows(t))
    for i, t in before.items():
        words = iter((t or "").split())
        assert all(w in words for w in (after[i] or "").split())
        if i not in shared and not any(seen[w] > 1 for w in windows(t)):
            assert after[i] == t


def check_packing(texts, rows, end=0):
    encode = library_tokenizer(vocabulary("byte_bpe_50k.json")).encode
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts) and sorted(sequences) == list(range(len(sequences)))
    for i, t in texts.items():
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, end], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def stages(spark, small, docs):
    schema, rows = docs.schema, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, small).persist()
        if name == "packing":
            check_packing(rows, kept.collect())
            break
        got = {r.doc_id: r.text for r in kept.collect()}
        assert kept.schema == schema and kept.count() == len(got)
        if name == "quality rules":
            want = set()
            for i, t in rows.items():
                n, chars, symbols, lines, again, windows = brute_measures(t)
                if not (n < 50 or n > 1_000_000 or 2 * windows > n or chars < 2 * n or chars > 20 * n or 10 * symbols > 3 * n or 10 * again > 4 * lines):
                    want.add(i)
        elif name == "exact dedup":
            want = set({re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]): i for i in sorted(rows, reverse=True)}.values())
        elif name == "SimHash near-dedup":
            prints = {i: brute_print(t) for i, t in rows.items()}
            groups = components_of(rows, [(a, b) for a, b in itertools.combinations(sorted(rows), 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
            want = set(groups.values())
        else:
            want = set(rows)
            check_passages(rows, got)
            rows = got
        assert set(got) == want
        rows, docs = got, kept


def test_stages(spark, small):
    stages(spark, small, table(spark, small, "documents"))


def test_stages_on_awkward_rows(spark, small):
    """Nulls, ties, empty and very long texts; and a table without rows."""
    schema = table(spark, small, "documents").schema
    names = [f.name for f in schema.fields]
    prose = " ".join(f"word{i * 7 % 89} or{i}" for i in range(40)) + "."
    passage = " ".join(f"some{i} thing{i}" for i in range(30))
    texts = [None, "", " \n", prose, prose + " ", prose.upper(), f"{prose} {passage}", f"Other {passage} text " + " ".join(f"z{i} y" for i in range(30)), "a " * 60, " ".join(f"q{i}" for i in range(50_000)), "x" * 100_000]
    rows = [tuple({"doc_id": i, "text": t}.get(n) for n in names) for i, t in enumerate(texts)]
    stages(spark, small, spark.createDataFrame(rows, schema))
    docs = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0 and (name == "packing" or docs.columns == names)
