"""The conversation trie against a plain one."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from locusframe.llm import prefix_trie
from locusframe.llm.common import table


def plain(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", prefix_trie_hash(role, text), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = collections.defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    saved = {p: (len(m) - 1) * len(p[-1][1]) if p else 0 for p, m in nodes.items()}
    leaves = {p: 0 if kids[p] else 1 for p in nodes}
    for p in sorted(nodes, key=len, reverse=True):
        if p:
            saved[p[:-1]] += saved[p]
            leaves[p[:-1]] += leaves[p]
    ends = {p: ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)) for p, m in nodes.items()}
    return [(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items()]


def prefix_trie_hash(role, text):
    """Equal turns of the tests differ in role or are the same in all."""
    return 0


def check(df):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.conversation_trie(df).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain(rows))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Rounds of small tables: the number of partitions is all that they take time for."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, conv string"


def test_given_conversations(spark, small):
    check(table(spark, small, "conversations"))


def test_awkward_rows(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice("ua"), rng.choice(["", "x", "yé", None]), "d", "c") for c in (*range(12), 100, 101, 150, 205, 310, 999, 1234567) for t in range(rng.choice([1, 2, 3, 9]))]
    rows += [(7, None, None, None, None, None), (None, 1, "u", "x", "d", "c"), (3, 50, "u", "long " * 4000, "d", "c"), (3, 50, "u", "long " * 4000, "d", "c")]
    rows += [(500, t, "u", f"t{t // 2}", "d", "c") for t in range(300)] + [(501, t, "u", f"t{t // 2}", "d", "c") for t in range(290)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(df)
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0
    check(df.where("conv_id = 205"))


def test_long_conversation_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(200, t, "u", "same" if t % 3 else f"w{t}", "d", "c") for t in range(2500)] + [(c, t, "u", f"z{c % 2}", "d", "c") for c in (201, 202, 203, 299) for t in range(3)]
        df = spark.createDataFrame(rows, SCHEMA)
        found = prefix_trie.numbered_turns(df).where("conv = 200")
        assert sorted(r.pos for r in found.select("pos").collect()) == list(range(2500))
        check(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("shape", ["path", "caterpillar", "random", "star", "other names"])
def test_contraction_of_any_tree(spark, shape):
    """Trees of all shapes, small blocks, and paths whose nodes have different conversations."""
    rng = random.Random(7)
    n = 40
    parent = {0: None}
    for v in range(1, n):
        parent[v] = {"path": v - 1, "other names": v - 1, "caterpillar": v - 1 if v % 2 else max(0, v - 2), "random": rng.randrange(v), "star": 0}[shape]
    depth = {0: 0}
    for v in range(1, n):
        depth[v] = depth[parent[v]] + 1
    name = {v: (v if shape in ("other names", "random") else v // 7, depth[v] if shape != "caterpillar" else v) for v in range(n)}
    weight = {v: rng.randrange(100) for v in range(n)}
    kids = collections.Counter(parent.values())
    total = dict(weight)
    for v in range(n - 1, 0, -1):
        total[parent[v]] += total[v]
    if shape == "star":
        name = {v: (v, depth[v]) for v in range(n)}
    rows = [(*name[v], *(name[parent[v]] if v else (None, None)), kids[v], weight[v]) for v in range(n)]
    tree = spark.createDataFrame(rows, "conv bigint, depth bigint, pconv bigint, pdepth bigint, kids bigint, w bigint")
    got = prefix_trie.subtree_totals(tree, ["w"], block=4).collect()
    assert {(r.conv, r.depth): r.w for r in got} == {name[v]: total[v] for v in range(n)} and len(got) == n


def test_hash_of_a_prefix_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), (F.col("id") % 7).cast("string").alias("text"))
    take = lambda d: sorted(map(tuple, prefix_trie.numbered_turns(d).collect()))
    assert take(df) == take(df.coalesce(1)) and len(take(df)) == 3000
