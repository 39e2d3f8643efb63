"""Repeated windows of 51 words against brute force, in texts that marks and lines don't cut as their copies."""

import collections
import random

from locusframe.llm import substring_dedup

RUN = 51
SCHEMA = "doc_id bigint, text string, n_chars bigint"


def words_of(text):
    return [w.translate(substring_dedup._LOWER) for w in (text or "").encode().split()]


def brute_gone(rows):
    """The words that each (key, text) loses."""
    places = collections.defaultdict(list)
    for i, text in rows:
        words = words_of(text)
        for k in range(len(words) - RUN + 1):
            places[tuple(words[k : k + RUN])].append((i is None, i or 0, i, text, k))
    gone = collections.defaultdict(set)
    for found in places.values():
        least = min(found, key=lambda x: x[:2])  # ties of one key don't occur here
        first = min((x for x in found if x[2:4] == least[2:4]), key=lambda x: x[4])
        for _, _, i, text, k in found:
            if (i, text) != first[2:4] or k - first[4] >= RUN:
                gone[i, text] |= set(range(k, k + RUN))
    return gone


def cases():
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared, verse = fresh(120), " ".join(fresh(20)) + ".\nAs.\n" + " ".join(fresh(20)) + "\nNo\n" + " ".join(fresh(20))
    texts = [
        " ".join(fresh(30) + shared + fresh(40)),  # a line without marks
        " ".join(fresh(7) + shared[20:71] + fresh(9)),  # 51 words of it
        " ".join(fresh(11) + shared[20:70] + fresh(9)),  # 50: stays
        " ".join(fresh(5)) + ". " + " ".join(shared[60:]).upper() + ", " + " ".join(fresh(12)),
        f"{' '.join(fresh(9))} {verse} {' '.join(fresh(3))}",
        f"{verse} {' '.join(fresh(30))}",
        " ".join(["la"] * 130),
        " ".join(fresh(60) * 2),
        " ".join(f"“{a}.”" for a in shared[:55]),
        f"{' '.join(fresh(4))} {' '.join(chr(0x201C) + a + '.' + chr(0x201D) for a in shared[:55])} {' '.join(fresh(3))}",
        None, "",
    ]
    rows = list(enumerate(texts)) + [(None, " ".join(fresh(3) + shared[:60])), (0, texts[0])]
    edits = [" ".join(shared[:a] + fresh(2) + shared[b:]) for a, b in ((30, 31), (55, 60), (70, 70))]
    return rows + [(20 + i, t) for i, t in enumerate(edits)]


def test_every_repeated_window_is_found(spark):
    rows = cases()
    df = spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA)
    got = collections.defaultdict(set)
    text_of = {(r.doc_id, r.h): r.text for r in df.withColumn("h", substring_dedup._text_hash("text")).collect()}
    for r in substring_dedup.repeated_spans(df).collect():
        at = r.doc_id, text_of[r.doc_id, r._lf_text]
        assert not got[at] & set(range(r.start, r.stop))
        got[at] |= set(range(r.start, r.stop))
    want = brute_gone(rows)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v} and len(want) >= 8


def test_repeated_windows_are_cut(spark):
    rows = cases()
    df = spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA)
    cut = substring_dedup.remove_passages(df)
    assert cut.count() == len(rows) and cut.schema == df.schema
    kept = {r.doc_id: words_of(r.text) for r in cut.collect()}
    gone = brute_gone(rows)
    for i, text in rows:
        words = words_of(text)
        left = [w for k, w in enumerate(words) if k not in gone[i, text]]
        # paragraphs may take more, never less
        assert len(kept[i]) <= len(left) and set(kept[i]) <= set(left)
    assert kept[1] == [w for k, w in enumerate(words_of(rows[1][1])) if not 7 <= k < 58] and len(kept[2]) == 70
