"""Conversations packed whole, under all limits."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import conversation_packing as packing
from locusframe.llm.common import table
from locusframe.llm.packing import Limits
from locusframe.llm.queries import vocabulary
from locusframe.llm.token_cache import library_tokenizer

BYTES = "byte_bpe_50k.json"


def packed(df, limits, **more):
    return packing.pack_conversations(df, vocabulary(BYTES), 0, limits, **more).collect()


def check(rows, limits):
    sequences, items = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        items[r.item].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) <= limits.tokens and len(own) <= limits.segments and sum(r.loss for r in own) <= limits.loss
        seen = [r.item for r in own]
        assert len(set(seen)) == sum(a != b for a, b in zip([None, *seen], seen, strict=False))  # an item's segments stand together
    for own in items.values():
        assert len({r.sequence_id for r in own}) == 1
    return sequences


def test_conversations_that_fit_are_whole_and_in_order(spark, small):
    turns = table(spark, small, "conversations")
    limits = Limits(2048, 16, 1024)
    rows = packed(turns, limits)
    sequences = check(rows, limits)
    tokenizer = library_tokenizer(vocabulary(BYTES))
    want = collections.Counter((r.conv_id, r.turn, r.role, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in turns.collect())
    by_turn, own = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        by_turn[r.conv_id, r.turn, r.role] += r.length
        own[r.conv_id].append(r)
        assert r.loss == (r.length if r.role == "assistant" else 0)
    assert collections.Counter((*k, n) for k, n in by_turn.items()) == want
    whole = 0
    for mine in own.values():
        mine.sort(key=lambda r: (r.turn, r.start))
        if sum(r.length for r in mine) <= 2048 and len(mine) <= 16 and sum(r.loss for r in mine) <= 1024:
            whole += 1
            assert len({r.sequence_id for r in mine}) == 1 and [r.offset for r in mine] == sorted(r.offset for r in mine)
    assert whole > len(own) // 2 and len(sequences) < len(own)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_awkward_turns(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        rows = [(1, t, "user" if t % 2 else "assistant", f"word {t} " * (t % 5), "x") for t in range(200)] + [(2, None, None, None, "x"), (2, 0, "assistant", "", "x"), (None, 1, "user", "hello", "x"), (None, None, None, None, None)]
        rows += [(3, 0, "user", "long text " * 3000, "x"), (3, 1, "assistant", "answer " * 700, "x"), (4, 5, "user", "same", "x"), (4, 5, "user", "same", "x")]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, item string")
        limits = Limits(256, 8, 100)
        found = packed(df, limits, block_rows=16)
        check(found, limits)
        tokenizer = library_tokenizer(vocabulary(BYTES))
        want = sum(len(tokenizer.encode(r[3] or "", add_special_tokens=False).ids) + 1 for r in rows)
        assert sum(r.length for r in found) == want and {(r.conv_id, r.turn) for r in found} == {r[:2] for r in rows}
        for c in (1, 3):  # a large conversation's runs follow one another
            own = sorted((r for r in found if r.conv_id == c), key=lambda r: (r.turn, r.start))
            items = [r.item for r in own]
            assert len(set(items)) == sum(a != b for a, b in zip([None, *items], items, strict=False)) > 1
        assert packed(df.limit(0), limits) == []
        with pytest.raises(ValueError, match="2 at least"):
            packed(df, Limits(1024, 1, 10))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_little_is_wasted(spark):
    turns = table(spark, "/root/testdata/sf0.01", "conversations")
    rows = packed(turns, Limits(2048, 64, 2048))
    fill = collections.Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert sum(fill.values()) / (2048 * len(fill)) > 0.9
