"""The substring stage deals texts out once and leaves no tables but those that its result reads, on small and large tables alike."""

import collections
import os
import random

import pytest

from locusframe.llm import common, substring_dedup
from tests.llm.test_spans import SCHEMA, brute_gone, cases, words_of


@pytest.fixture(params=["small", "large"])
def way(request, spark, monkeypatch):
    """Sides that are broadcast, and sides that are too large for it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param == "large":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        monkeypatch.setattr(substring_dedup, "SMALL", 0)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_joined_where_they_lie(spark, way, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_root", lambda _: str(tmp_path))
    rows = cases()
    cut = substring_dedup.remove_passages(spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert sorted(x.split("-")[0] for x in os.listdir(tmp_path)) == ["removals", "spans", "texts"]
    kept, gone = {r.doc_id: words_of(r.text) for r in cut.collect()}, brute_gone(rows)
    assert cut.count() == len(rows)
    for i, text in rows:
        left = [w for k, w in enumerate(words_of(text)) if k not in gone[i, text]]
        assert len(kept[i]) <= len(left) and set(kept[i]) <= set(left)
    assert kept[1] == [w for k, w in enumerate(words_of(rows[1][1])) if not 7 <= k < 58] and len(kept[2]) == 70


def test_rows_that_recur(spark):
    rng = random.Random(3)
    values = [rng.randrange(40) for _ in range(60)] + [99] * 50
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = substring_dedup.recurring(spark.createDataFrame(list(enumerate(values)), "i int, v bigint"), "v").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    times = collections.Counter(values)
    assert sorted((r.i, r.v) for r in got) == [(i, v) for i, v in enumerate(values) if times[v] > 1]
