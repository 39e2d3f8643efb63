"""Near copies and passages go from the text that has them, not from all rows under its key."""

import random

from locusframe.llm import simhash, substring_dedup

SCHEMA = "doc_id bigint, text string"
RNG = random.Random(4)
A, B, C, D = (" ".join(f"w{RNG.randrange(10**9)}" for _ in range(300)) for _ in range(4))


def test_other_texts_under_a_key_stay(spark):
    near = A.replace(" ", "  ", 1)  # other white space, same words
    rows = [(1, A), (None, near), (None, B), (None, C), (5, near), (5, D), (6, B + " "), (6, B + " "), (7, C + " "), (7, C + "  ")]
    got = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 4
    assert {(i, t.split()[0]) for i, t in got} == {(1, A.split()[0]), (6, B.split()[0]), (7, C.split()[0]), (5, D.split()[0])}
    alone = [(None, B), (None, C), (1, A), (None, near)]
    got = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(alone, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(None, B), (None, C), (1, A)], key=str)


def test_passages_go_from_their_own_text(spark):
    passage = " ".join(f"{a} b{i} c{i} d e f g h{i} i{i}." for i, a in enumerate(A.split()[:5]))
    other = " ".join(f"{a} s{i} t{i} u v w x y{i} z{i}." for i, a in enumerate(B.split()[:5]))
    rows = [(1, passage), (2, f"Begin.\n{passage}\nEnd."), (2, other)]
    kept = {(r.doc_id, r.text) for r in substring_dedup.remove_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {(1, passage), (2, "Begin.\nEnd."), (2, other)}


def test_null_keys_take_part_and_come_last(spark):
    passage = " ".join(f"{a} b{i} c{i} d e f g h{i} i{i}." for i, a in enumerate(A.split()[:5]))
    rows = spark.createDataFrame([(None, f"Begin.\n{passage}\nEnd."), (2, passage)], SCHEMA)
    told = substring_dedup.repeated_passages(rows).collect()
    assert {r.doc_id for r in told if r.removed} == {None} and {r.component_doc for r in told} == {2}
    assert {(r.doc_id, r.text) for r in substring_dedup.remove_passages(rows).collect()} == {(None, "Begin.\nEnd."), (2, passage)}
