"""Each operator against a brute-force version, on a small table and on a table of awkward rows."""

import collections
import hashlib
import io
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from locusframe.llm import bpe, common, components, exact_dedup, packing, quality_rules, sharding, simhash, substring_dedup, token_store, warc
from locusframe.llm.common import shared_path, table
from locusframe.llm.queries import vocabulary
from locusframe.llm.shared_files import whole_file
from locusframe.llm.token_cache import library_tokenizer, text_encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, `key` string, fp string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PASSAGE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. Lambda mu nu xi omicron pi rho sigma tau upsilon. Phi chi psi omega one two three four five six seven. Eight nine ten eleven twelve thirteen fourteen fifteen sixteen."


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    texts = [None, "", " ", "one", "one", "a b  c\td", "a b c d", "x\n\nx\nx", LONG, LONG + " end", "A's <|endoftext|> é́ 中文 #$%", "tab\there\x85and there", f"first words. {PASSAGE} Then other.", f"Elsewhere it is told.\n{PASSAGE}"]
    rows = [(i, t, None, "s", 3, "z", "k", "f") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "one", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return table(spark, small, "documents")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


# 1


def test_sharding(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = sharding.shard_documents(df, [1.0] * 8, [1.0] * 9).collect()
        want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts_of(df)]
        same([(r.doc_id, r.size, r.text_crc32) for r in rows], want)
        assert all(r.grown_shard in (r.shard, 8) for r in rows)
        for shard in {r.shard for r in rows}:
            own = sorted(r.slot for r in rows if r.shard == shard)
            assert own == list(range(len(own)))
        by_key = collections.defaultdict(set)
        for r in rows:
            by_key[r.doc_id].add((r.shard, r.grown_shard))
        assert all(len(v) == 1 for v in by_key.values())
    assert sharding.shard_documents(empty, [1.0], [1.0, 2.0]).count() == 0
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    counts = {r["shard"]: r["count"] for r in sharding.shard_documents(many, [1.0, 1.0, 2.0], [1.0] * 4).groupBy("shard").count().collect()}
    assert abs(counts[2] / 20000 - 0.5) < 0.02 and abs(counts[0] / 20000 - 0.25) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.col("doc_id"), [])


# 2


def page_rows():
    return [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 5000), (6, "u", "WARC/1.1\r\n\r\n\x1f\x8b"), (7, "u\r\nX: y", "<p>x</p>"), (7, "u", "<p>x</p>"), (1, "again", "<p>x</p>"), (None, "n", "<p>n</p>"), (None, "n", "<p>n</p>")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string").withColumn("path", F.lit("clash"))
    rows = warc.archive_round_trip(spark, pages).collect()
    bodies = [(p, (h or "").encode()) for p, _, h in page_rows()]
    same([(r.page_id, r.payload_bytes, r.payload_digest) for r in rows], [(p, len(b), warc.base32_sha1(b)) for p, b in bodies])
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.payload_digest].append(r)
    for own in groups.values():
        first = [r for r in own if r.record_type == "response"]
        ids = [r.page_id for r in own if r.page_id is not None]
        assert len(first) == 1 and first[0].page_id == (min(ids) if ids else None) and first[0].refers_to is None
        assert all(r.refers_to == first[0].page_id for r in own if r.record_type == "revisit")
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


class Memory:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    bodies = [bytes([65 + i]) * (50 + 3000 * i) + b"\r\n\r\nWARC/1.1\r\n" for i in range(6)]
    raw = [warc.record_bytes("response", f"urn:page:{i}", "u", warc._HTTP % len(b) + b, "1970-01-01T00:00:00Z", warc.base32_sha1(b)) for i, b in enumerate(bodies)]
    parts = [warc.gzip_member(r) for r in raw] if packed else raw
    read = lambda data: list(warc.SalvageReader(Memory(data), len(data)))
    assert [x.payload for x in read(b"".join(parts))] == bodies
    hurt = bytearray(parts[2])
    hurt[len(hurt) // 2] ^= 0xFF
    data = b"".join([*parts[:2], bytes(hurt), parts[3], parts[4][: len(parts[4]) // 2], parts[5], b"tail"])
    found = read(data)
    assert [x.payload for x in found if isinstance(x, warc.Record)] == [bodies[0], bodies[1], bodies[3], bodies[5]]
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert [(g.offset, g.length) for g in gaps] == [(len(parts[0]) + len(parts[1]), len(hurt)), (sum(map(len, parts[:4])), len(parts[4]) // 2), (len(data) - 4, 4)]
    assert sum(x.length for x in found) == len(data) and read(b"") == []
    assert [type(x) for x in read(b"junk" + parts[0])] == [warc.Gap, warc.Record]


def test_warc_headers_of_any_length_and_mixed_archives(spark):
    pages = spark.createDataFrame([(1, "http://a/" + "u" * 1_200_000, "<p>x</p>"), (2, "u", "<p>y</p>")], "page_id bigint, url string, html string")
    assert sorted(r.page_id for r in warc.archive_round_trip(spark, pages).collect()) == [1, 2]
    raw = [warc.record_bytes("response", f"urn:page:{i}", "u", warc._HTTP % 3 + b"abc", "1970-01-01T00:00:00Z", warc.base32_sha1(b"abc")) for i in range(4)]
    hurt = bytearray(warc.gzip_member(raw[1]))
    hurt[len(hurt) // 2] ^= 0xFF
    data = b"".join([warc.gzip_member(raw[0]), bytes(hurt), raw[2], warc.gzip_member(raw[3]), b"WARC/1.1\r\nno header line here\r\n"])
    found = list(warc.SalvageReader(Memory(data), len(data)))
    assert [x.fields["warc-record-id"] for x in found if isinstance(x, warc.Record)] == [f"<urn:page:{i}>" for i in (0, 2, 3)]
    assert [x.length for x in found if isinstance(x, warc.Gap)] == [len(hurt), 31]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_of_damaged_archives(spark, small, packed):
    pages = table(spark, small, "pages")
    rows = warc.salvage(spark, pages, F.col("page_id") % 7 == 3, packed).collect()
    assert len(rows) == pages.count() and all(r.recovered == (r.page_id % 7 != 3) for r in rows)
    assert all((r.gap_bytes or 0) > 0 and r.gap_reason for r in rows if not r.recovered) and all(r.gap_bytes is None for r in rows if r.recovered)


def test_archives_are_closed_by_size(spark, small):
    pages = table(spark, small, "pages").coalesce(1)
    archives = warc.write_archives(pages, shared_path(spark, "warc"), archive_bytes=20_000)
    assert archives.count() > 3 and warc.read_archives(archives).where("reason is null").count() == pages.count()


def test_second_attempt_keeps_the_file(tmp_path):
    for _ in range(2):
        with whole_file(str(tmp_path / "a")) as out:
            out.write(b"same")
    assert (tmp_path / "a").read_bytes() == b"same" and len(list(tmp_path.iterdir())) == 1


def test_sorted_sides_give_the_same(spark, docs, monkeypatch):
    """Without any broadcast by count, results are those with it."""
    jobs = [lambda: exact_dedup.exact_dedup(docs), lambda: exact_dedup.keep_first(docs), lambda: simhash.simhash_components(docs), lambda: simhash.keep_one(docs), lambda: substring_dedup.remove_passages(docs)]
    want = [j().collect() for j in jobs]
    for module in (common, exact_dedup, simhash, substring_dedup, warc):
        monkeypatch.setattr(module, "broadcast_if_small", lambda df, rows=0: df)
    for job, rows in zip(jobs, want, strict=True):
        same(job().collect(), rows)


# 3


def brute_paragraphs(text):
    out = []
    for line in (text or "").encode().split(b"\n"):
        own, since = [], 0
        for word in line.split():
            own.append(word)
            since += 1
            if word.endswith((b".", b"!", b"?")):
                if since >= substring_dedup.SENTENCE:
                    out.append(own)
                    own = []
                since = 0
        if own:
            out.append(own)
    return out


def brute_passages(rows, least=0.8):
    units = {}
    last = 10**12  # null keys come last, each of their texts by itself
    nameless = {t: last + n for n, t in enumerate(sorted({t for d, t in rows if d is None and t}))}
    for doc, text in sorted({(nameless.get(t, last) if d is None else d, t) for d, t in rows}, key=lambda x: (x[0], x[1] or "")):
        for n, words in enumerate(brute_paragraphs(text)):
            if len(words) >= 5:
                units[doc, n] = [w.lower() if w.isascii() else w.translate(substring_dedup._LOWER) for w in words]
    sets = {u: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for u, w in units.items()}
    by = collections.defaultdict(set)
    for u, s in sets.items():
        for g in s:
            by[g].add(u)
    pairs = {p for us in by.values() for p in itertools.combinations(sorted(us), 2)}
    return units, [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in pairs]


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_passages(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = substring_dedup.repeated_passages(df).collect()
        assert all(r.doc_id is not None for r in rows)  # no passage of these tables is lost from a null key
        units, pairs = brute_passages(texts_of(df))
        strong = components_of(units, [(a, b) for a, b, j in pairs if j >= 0.8])
        got = {(r.doc_id, r.number): (r.component_doc, r.component_number) for r in rows}
        assert len(got) == len(rows)
        # every returned paragraph is in the component that brute force gives it, and each such component is named by its least member
        assert all(strong[u] == c for u, c in got.items())
        again = {u for u in units if strong[u] != u}
        runs, removed = collections.defaultdict(list), set()
        for doc, n in sorted(again, key=lambda u: (u[0], u[1])):
            own = runs[doc]
            own.append([n]) if not own or own[-1][-1] != n - 1 else own[-1].append(n)
        for doc, own in runs.items():
            for run in own:
                if sum(len(units[doc, n]) for n in run) >= substring_dedup.LEAST_WORDS:
                    removed |= {(doc, n) for n in run}
        found = {(r.doc_id, r.number) for r in rows if r.removed}
        assert found <= removed and len(found) >= 0.98 * len(removed)
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_passages_are_cut(odd):
    rows = {r.doc_id: r for r in substring_dedup.remove_passages(odd).collect()}
    assert rows[12].text.count("Lambda") == 1 and "Lambda" not in rows[13].text and "Elsewhere" in rows[13].text
    assert rows[13].n_chars == len(rows[13].text) and rows[0].text is None and rows[13].shard == "z"
    assert substring_dedup.remove_passages(odd).count() == odd.count() and substring_dedup.remove_passages(odd).schema == odd.schema


def test_band_recall():
    rng, hits = random.Random(5), 0
    for _ in range(300):
        a = [f"w{rng.randrange(10**9)}" for _ in range(49)]
        b = [*a[:-5], *[f"v{rng.randrange(10**9)}" for _ in range(5)]]  # 40 of 50 shingles shared: similarity 0.8
        keys = [substring_dedup.Paragraphs([" ".join(x).encode()]) for x in (a, b)]
        x, y = (k.bands(np.array([0]))[:, 0] for k in keys)
        hits += bool(set(x.tolist()) & set(y.tolist()))
    assert hits >= 0.96 * 300


# 4


def whole_ids(name, text):
    return library_tokenizer(vocabulary(name)).encode(text or "", add_special_tokens=False).ids


def test_token_files(spark, docs, odd, empty):
    for df in (docs.limit(150), odd):
        df = df.persist()
        manifest = token_store.write_token_files(df, shared_path(spark, "t"), vocabulary("word_bpe_49k.json"), 2, 3, frame_bytes=3000)
        rows = token_store.read_token_files(manifest).orderBy("start").collect()
        want = sorted([(i, [*whole_ids("word_bpe_49k.json", t), 2]) for i, t in texts_of(df)], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        assert [r.key for r in rows] == [i for i, _ in want]
        same([(r.key, *r.ids) for r in rows], [(i, *ids) for i, ids in want])
        at = 0
        for r in rows:
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
            at += r.n_tokens
        some = token_store.read_token_files(manifest, wanted=df.where("doc_id in (3, 7)").select("doc_id")).collect()
        assert {r.key for r in some} == {3, 7} & {i for i, _ in want}
    assert token_store.token_files_digest(spark, empty, vocabulary("word_bpe_49k.json"), 2, 2).count() == 0


class Sized(Memory):
    def size(self):
        return len(self.data)


def test_token_frames_are_read_alone_and_checked():
    import pyarrow as pa
    import zstandard

    out = io.BytesIO()
    writer = token_store.FrameWriter(out, frame_bytes=400)
    data = [np.arange(i * 7, dtype="<u4").tobytes() for i in range(30)]
    for i, d in enumerate(data):
        writer.add(i, d)
    assert writer.close(pa.int64()) == len(out.getvalue())
    raw = out.getvalue()
    reader = token_store.FrameReader(Sized(raw))
    assert [reader.ids(i) for i in range(30)] == data and len(reader.frames) > 5
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(data)
    hurt = bytearray(raw)
    hurt[int(reader.starts[3]) + 8] ^= 1
    other = token_store.FrameReader(Sized(bytes(hurt)))
    assert other.ids(0) == data[0]
    with pytest.raises(Exception):  # noqa: B017
        [other.ids(i) for i in range(30)]


# 5


def test_bpe(docs, odd, empty):
    tokenizer = library_tokenizer(vocabulary("word_bpe_49k.json"))
    for df in (docs, odd):
        got = bpe.bpe_round_trip(df, vocabulary("word_bpe_49k.json"), full=True).collect()
        want = []
        for i, t in texts_of(df):
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            decoded = tokenizer.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), tuple(ids), decoded))
        same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in got], want)
    assert bpe.bpe_round_trip(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_encoders_on_random_texts():
    import pyarrow as pa

    rng = random.Random(1)
    letters = [*" \n\t \x1c\x85'sS.,!?ÀéßŒIİΣa1²٣́　中|$#\x00abcσς가", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 24))) for _ in range(3000)]
    texts += ["".join(rng.choice("abinthe") for _ in range(rng.randint(1, 40))) for _ in range(500)] + ["a" * k for k in range(40)]
    own = bpe.WordBpe(vocabulary("word_bpe_49k.json")).round_trips(pa.array(texts))
    tokenizer = library_tokenizer(vocabulary("word_bpe_49k.json"))
    for text, (ids, decoded) in zip(texts, own, strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == tokenizer.decode(want, skip_special_tokens=False)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = text_encoder(vocabulary(name))
        ids, at = encoder.encode_all(pa.array(texts))
        for k, text in enumerate(texts):
            want = whole_ids(name, text)
            assert ids[at[k] : at[k + 1]].tolist() == want and np.frombuffer(encoder.encode(text), "<u4").tolist() == want


# 6


def brute_measures(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(hit))


def test_quality_ledger(docs, odd, empty):
    for df in (docs, odd):
        rows = quality_rules.apply_policy(quality_rules.ledger(df)).collect()
        want = [(i, *brute_measures(t)) for i, t in texts_of(df)]
        same([(r.doc_id, *[r[m] for m in quality_rules.MEASURES]) for r in rows], want)
        for r in rows:
            base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == base and r.kept == (r.failed == 0) and not (base and r.kept)
        kept = quality_rules.keep_good(df)
        assert kept.schema == df.schema
        same([(r.doc_id, r.text) for r in kept.collect()], [(i, t) for i, t in texts_of(df) if i in {r.doc_id for r in rows if r.kept}])
        table_ = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(df)).collect()}
        for name in quality_rules.RULES:
            bit = quality_rules.rule_mask([name])
            assert table_[name].failing == sum(bool(r.failed & bit) for r in rows)
            assert table_[name].failing_alone == sum(r.failed == bit for r in rows) and table_[name].kept == sum(r.kept for r in rows)
    assert quality_rules.ledger(empty).count() == 0


def test_clean_documents_are_kept(spark):
    labels = table(spark, "/root/testdata/sf0.01", "labels").where("quality = 1")
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, "/root/testdata/sf0.01", "documents"))).join(labels, "doc_id").collect()
    assert all(r.kept == (not r.base_failed) for r in rows) and len(rows) > 300


# 7


def test_packing(docs, odd, empty):
    for df in (docs, odd):
        rows = packing.pack_documents(df, vocabulary("byte_bpe_50k.json"), 0, ids=True).collect()
        want = collections.Counter((i, *whole_ids("byte_bpe_50k.json", t), 0) for i, t in texts_of(df))
        by = collections.defaultdict(list)
        for r in rows:
            assert r.length == len(r.ids) <= 1024 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            by[r.doc_id].append(r)
        for i, own in by.items():
            copies = sum(n for k, n in want.items() if k[0] == i)
            if copies == 1:
                own.sort(key=lambda r: r.start)
                assert (i, *[x for r in own for x in r.ids]) in want and own[0].doc_tokens == sum(r.length for r in own)
                assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in rows) == sum((len(k) - 1) * n for k, n in want.items())
        check_sequences(rows, packing.Limits(), lambda r: r.length)
    assert packing.pack_documents(empty, vocabulary("byte_bpe_50k.json"), 0).count() == 0


def check_sequences(rows, limits, loss):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) <= limits.tokens and len(own) <= limits.segments and sum(map(loss, own)) <= limits.loss
    return sequences


def test_packing_wastes_little(docs):
    rows = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 0).collect()
    filled = collections.Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert sum(filled.values()) / (1024 * len(filled)) > 0.98


# 8


def brute_print(text, n=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, odd, empty):
    for df in (docs, odd):
        prints = [(i, brute_print(t)) for i, t in texts_of(df)]
        values = sorted({p for _, p in prints})
        groups = components_of(values, [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 4])
        least = {}
        for i, p in prints:
            if i is not None:
                least[groups[p]] = min(i, least.get(groups[p], i))
        got = simhash.simhash_components(df).collect()
        same([(r.doc_id, r.fingerprint, r.component_id) for r in got], [(i, f"{p:016x}", least.get(groups[p])) for i, p in prints])
        kept = simhash.keep_one(df)
        assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} - {None} <= set(least.values())
    assert simhash.simhash_components(empty).count() == 0


def test_pigeonring_loses_no_pair(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(30)} | {0, 2**64 - 1, 1, 15})
    near = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 4]
    want = components_of(values, near)
    for rows in (simhash.BLOCK_ROWS, 5):  # 5: every bucket of some size is dealt out in blocks
        fps = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp bigint")
        links = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(fps, block_rows=rows).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in links)
        assert components_of(values, links) == want


def test_components(spark):
    rng = random.Random(2)
    for n, m in ((200, 120), (60, 300), (300, 299)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != n - 1 else [(i, i + 1) for i in range(m)]
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame([*edges, (None, 1)], "x int, y int"), "x", "y").collect()}
        want = components_of(range(n), edges)
        assert got == {i: want[i] for i in range(n) if any(i in e and e[0] != e[1] for e in edges)}
    assert components.connected_components(spark.createDataFrame([], "x int, y int"), "x", "y").count() == 0


# 10


def test_exact_dedup(docs, odd, empty):
    for df in (docs, odd):
        groups = collections.defaultdict(list)
        for i, t in texts_of(df):
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
        want = []
        for text, ids in groups.items():
            ids.sort(key=lambda i: (i is None, i or 0))
            digest = hashlib.sha256(text.encode()).hexdigest()
            want += [(i, ids[0], len(ids), n == 0, digest) for n, i in enumerate(ids)]
        got = exact_dedup.exact_dedup(df).collect()
        same([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], want)
        kept = exact_dedup.keep_first(df)
        assert kept.schema == df.schema
        same([(r.doc_id,) for r in kept.collect()], [(w[0],) for w in want if w[3]])
    assert exact_dedup.exact_dedup(empty).count() == 0
