"""Operator 12: the trie of conversation prefixes, its subtree totals by parallel tree contraction.

Turns are numbered and their prefixes hashed in sorted partitions, so a conversation may be spread over many tasks: two
64-bit sums of (hash of a turn) x (odd base)^place, modulo 2^64, tell a prefix (a chance of about n^2 / 2^125 of any mix-up
among n). Prefixes with one hash are a node, named by its smallest conversation and its depth. Totals come from rounds of
joins: compress puts unary chains together, rake adds leaves to their parents, until the root is left; then the rounds are
undone in reverse order, and each contracted node's total is its survivor's total less what stood before it in the chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import written

#: Odd bases of the two prefix sums.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Depths that one task compresses together in the first round; eight times as many in each further round.
BLOCK = 1024
#: Conversations whose numbers are put together before they go to the task that hashes a node's members.
_IDS = 8192
_EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["conv", "depth"]


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base^exponents modulo 2^64 (negative ones by the inverse)."""
    with np.errstate(over="ignore"):
        e = np.abs(exponents).astype(np.uint64)
        factor = np.where(exponents < 0, np.uint64(pow(base, -1, 1 << 64)), np.uint64(base))
        out = np.ones(len(e), np.uint64)
        while e.any():
            out = np.where(e & np.uint64(1), out * factor, out)
            factor, e = factor * factor, e >> np.uint64(1)
    return out


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _turn_rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, x1, x2, chars): hashes instead of texts; rows without a conversation are left out."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = conversations.where(F.col(conv).isNotNull())
    return rows.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), said[0].alias("role"), F.xxhash64(*said).alias("x1"), F.xxhash64(F.lit(1), *said).alias("x2"), F.length(said[1]).cast("bigint").alias("chars"))


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, k1, k2, p1, p2, chars): each turn's place from 0, the prefix's hash with it and before it, and its code points.

    Turns are ordered by ``turn``, null first; equal ones by role, then by the hash of the text. Null roles and texts are
    empty, rows without a conversation are left out. Partitions are ranges of all turns; a conversation that lies in more
    than one is put together from its parts' numbers and sums (at most two parts a partition).
    """
    order = ["conv", "turn", "role", "x1", "x2"]
    ranged = _turn_rows(conversations, conv, turn, role, text).repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "x1", "x2", "chars")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, sums = TaskContext.get().partitionId(), None, 0, np.zeros(2, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, chars = _columns(batch, "conv", "chars")
            starts = np.flatnonzero(np.concatenate([[own[0] != last], own[1:] != own[:-1]]))
            run = np.searchsorted(starts, np.arange(len(own)), "right")  # 0: the conversation that the last batch ended with
            at = np.arange(len(own)) - np.concatenate([[-seen], starts])[run]
            out = [pa.array(np.full(len(own), part)), pa.array(own), pa.array(at)]
            with np.errstate(over="ignore"):
                for i, base in enumerate(_BASES):
                    term = batch.column(f"x{i + 1}").to_numpy().view(np.uint64) * _powers(base, at + 1)
                    total = np.cumsum(term, dtype=np.uint64)
                    prefix = total - np.concatenate([[np.uint64(0) - sums[i]], (total - term)[starts]])[run]
                    sums[i] = prefix[-1]
                    out += [_signed(prefix), _signed(prefix - term)]
            last, seen = own[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*out, pa.array(chars)], ["part", "conv", "at", "k1", "p1", "k2", "p2", "chars"])

    parts = written(ranged.mapInArrow(walk, "part bigint, conv bigint, at bigint, k1 bigint, p1 bigint, k2 bigint, p2 bigint, chars bigint"), "turns")
    # a conversation in several partitions is the first or the last of each of them: two rows a partition at most
    edges = parts.groupBy("part").agg(F.min("conv").alias("lo"), F.max("conv").alias("hi")).select("part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("conv"))
    many = edges.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    last_of = lambda c: F.max_by(c, "at").alias(c)
    segments = parts.join(F.broadcast(many), "conv").groupBy("conv", "part").agg((F.max("at") + 1).alias("n"), last_of("k1"), last_of("k2"))

    def fold(table: pa.Table) -> pa.Table:
        """One conversation: a row a partition."""
        table = table.sort_by("part")
        n = table.column("n").to_numpy()
        before = np.cumsum(n) - n
        out = [table.column("conv"), table.column("part"), pa.array(before)]
        with np.errstate(over="ignore"):
            for i, base in enumerate(_BASES):
                whole = table.column(f"k{i + 1}").to_numpy().view(np.uint64) * _powers(base, before)
                out.append(_signed(np.cumsum(whole, dtype=np.uint64) - whole))
        return pa.table(out, names=["conv", "part", "before", "b1", "b2"])

    offsets = written(segments.groupBy("conv").applyInArrow(fold, "conv bigint, part bigint, before bigint, b1 bigint, b2 bigint"), "offsets")
    joined = parts.join(F.broadcast(offsets), ["conv", "part"], "left").fillna(0, ["before", "b1", "b2"])
    return joined.select("conv", (F.col("at") + F.col("before")).alias("pos"), "k1", "k2", "p1", "p2", "b1", "b2", "before", "chars").mapInArrow(_shifted, "conv bigint, pos bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, chars bigint")


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes k and p as b + (sum so far) x base^before, less the own sum ``s`` where the batch has one."""
    for batch in batches:
        names = batch.schema.names
        out = {n: batch.column(n) for n in names if n not in ("b1", "b2", "s1", "s2", "before")}
        before = batch.column("before").to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            for i, base in enumerate(_BASES):
                power = _powers(base, before)
                start = batch.column(f"b{i + 1}").to_numpy(zero_copy_only=False).view(np.uint64)
                own = batch.column(f"s{i + 1}").to_numpy(zero_copy_only=False).view(np.uint64) if "s1" in names else np.uint64(0)
                for c in (f"k{i + 1}", f"p{i + 1}"):
                    out[c] = _signed(start + power * (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) - own))
        yield pa.RecordBatch.from_pydict(out)


def grafted_prefixes(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The prefixes of rebuilt conversations, and (conv, length) of these.

    Conversation c starts with the first h turns of conversation c - c % ``every`` (all it has, none if it is absent) and
    goes on with its own turns after its first h, h = crc32(c) % ``most``. Prefixes are (conv, depth, k1, k2, p1, p2, chars).
    Only h turns of a conversation are ever lent, and by ``every`` others at most.
    """
    head = F.when(F.col("pos") < most - 1, F.struct("pos", "k1", "k2", "p1", "p2", "chars"))
    convs = written(turns.groupBy("conv").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(head)).alias("heads")), "conversations")
    lender = convs.select(F.col("conv").alias("_lender"), F.col("n").alias("_n"), F.col("heads").alias("lent"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).cast("bigint")
    own = convs.withColumn("h", h).join(lender, F.col("conv") - F.col("conv") % every == F.col("_lender"), "left")
    m = F.least("h", F.coalesce("_n", F.lit(0)))
    key = lambda heads, at, c: F.coalesce(F.get(F.col(heads), F.col(at).cast("int") - 1)[c], F.lit(0))
    graft = own.withColumn("m", m).select(
        "conv", "h", "m", "lent", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        key("lent", "m", "k1").alias("b1"), key("lent", "m", "k2").alias("b2"), key("heads", "h", "k1").alias("s1"), key("heads", "h", "k2").alias("s2"),
    )
    graft = written(graft, "grafts")
    first = graft.where("m > 0").select("conv", F.explode(F.slice("lent", F.lit(1), F.col("m").cast("int"))).alias("t")).select("conv", (F.col("t.pos") + 1).alias("depth"), *[f"t.{c}" for c in ("k1", "k2", "p1", "p2", "chars")])
    rest = turns.join(graft.select("conv", "h", "m", "b1", "b2", "s1", "s2"), "conv").where("pos >= h")
    rest = rest.select("conv", (F.col("m") + F.col("pos") - F.col("h") + 1).alias("depth"), "k1", "k2", "p1", "p2", "chars", "b1", "b2", "s1", "s2", (F.col("m") - F.col("h")).alias("before"))
    schema = "conv bigint, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, chars bigint"
    return first.unionByName(rest.mapInArrow(_shifted, schema)), graft.select("conv", "length")


def _compressed(live: DataFrame, block: int, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(live nodes, contracted ones): each run of unary nodes of one conversation, with the node below it if that is a leaf or
    unary, becomes its top. Runs end at multiples of ``block``, so no task gets more than a block's nodes of one conversation."""
    by = Window.partitionBy("conv", F.floor(F.col("depth") / block)).orderBy("depth")
    above = F.lag("depth").over(by)
    joined = (F.col("kids") <= 1) & (F.lag("kids").over(by) == 1) & F.lag("pconv").over(by).isNotNull() & (F.col("pconv") == F.col("conv")) & (F.col("pdepth") == above)
    runs = live.withColumn("_new", ~F.coalesce(joined, F.lit(False))).withColumn("_top", F.max(F.when(F.col("_new"), F.col("depth"))).over(by))
    run = Window.partitionBy("conv", F.floor(F.col("depth") / block), "_top").orderBy("depth")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = runs.withColumns(
        {f"_b_{v}": F.coalesce(F.sum(v).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for v in values}
        | {f"_w_{v}": F.sum(v).over(whole) for v in values}
        | {"_kids": F.last("kids").over(whole), "_bottom": F.last("depth").over(whole)}
    )
    marked = written(marked, "runs")
    gone = marked.where("depth <> _top").select(*NODE, F.col("conv").alias("rconv"), F.col("_top").alias("rdepth"), *[F.col(f"_b_{v}").alias(v) for v in values])
    tops = marked.where("depth = _top").select(*NODE, "pconv", "pdepth", F.col("_kids").alias("kids"), *[F.col(f"_w_{v}").alias(v) for v in values])
    # what hung below a run's last node hangs below its top
    moved = marked.where("depth = _top and _bottom > _top").select(F.col("conv").alias("_c"), F.col("_bottom").alias("_d"), F.col("_top").alias("_to"))
    hung = tops.join(moved, (F.col("pconv") == F.col("_c")) & (F.col("pdepth") == F.col("_d")), "left")
    return hung.withColumn("pdepth", F.coalesce("_to", "pdepth")).drop("_c", "_d", "_to"), gone


def _raked(live: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(live nodes without leaves, the leaves): parents get their leaves' sums."""
    leaves = live.where("kids = 0 and pconv is not null")
    sums = leaves.groupBy("pconv", "pdepth").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_s_{v}") for v in values])
    sums = sums.withColumnsRenamed({"pconv": "_c", "pdepth": "_d"})
    rest = live.where("kids > 0 or pconv is null").join(sums, (F.col("conv") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
    added = {"kids": F.col("kids") - F.coalesce("_n", F.lit(0))} | {v: F.col(v) + F.coalesce(f"_s_{v}", F.lit(0)) for v in values}
    return rest.withColumns(added).select(live.columns), leaves.select(*NODE, *values)


def _spliced(live: DataFrame, turn: int, values: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """(live nodes, contracted ones) after unary nodes below unary ones of other conversations or blocks are taken out.

    A coin for node and round says which: one that shows heads below one that shows tails, so no two neighbours go at
    once and a quarter goes in a round. None if there are no such nodes.
    """
    coin = F.pmod(F.xxhash64("conv", "depth", F.lit(turn)), F.lit(2))
    unary = live.where("kids = 1 and pconv is not null").withColumn("_coin", coin)
    upper = unary.where("_coin = 0").select(F.col("conv").alias("rconv"), F.col("depth").alias("rdepth"), *[F.col(v).alias(f"_u_{v}") for v in values])
    pairs = unary.where("_coin = 1").join(upper, (F.col("pconv") == F.col("rconv")) & (F.col("pdepth") == F.col("rdepth")))
    pairs = written(pairs.select(*NODE, "rconv", "rdepth", *values, *[f"_u_{v}" for v in values]), "splices")
    if pairs.isEmpty():
        return None
    told = pairs.select(*NODE, F.lit(True).alias("_gone"), *[F.lit(0).cast("bigint").alias(f"_a_{v}") for v in values])
    told = told.unionByName(pairs.select(F.col("rconv").alias("conv"), F.col("rdepth").alias("depth"), F.lit(False).alias("_gone"), *[F.col(v).alias(f"_a_{v}") for v in values]))
    rest = live.join(told, NODE, "left").where("not coalesce(_gone, false)").withColumns({v: F.col(v) + F.coalesce(f"_a_{v}", F.lit(0)) for v in values}).select(live.columns)
    moved = pairs.select(F.col("conv").alias("_c"), F.col("depth").alias("_d"), "rconv", "rdepth")
    hung = rest.join(moved, (F.col("pconv") == F.col("_c")) & (F.col("pdepth") == F.col("_d")), "left")
    hung = hung.withColumns({"pconv": F.coalesce("rconv", "pconv"), "pdepth": F.coalesce("rdepth", "pdepth")}).select(live.columns)
    return hung, pairs.select(*NODE, "rconv", "rdepth", *[F.col(f"_u_{v}").alias(v) for v in values])


def subtree_totals(tree: DataFrame, values: list[str], block: int = BLOCK, rounds: int = 300) -> DataFrame:
    """(conv, depth, values): the sums of ``values`` over each node's subtree.

    ``tree`` has a row a node: conv, depth, its parent's pconv and pdepth (null at the one root), kids (children) and the
    long ``values``. An empty tree gives an empty table. A round is a window and a few joins, each written; the nodes left
    shrink geometrically, and so do the tables of the way back. ``rounds`` is a guard: passing it raises.
    """
    names = [*NODE, "pconv", "pdepth", "kids", *values]
    live, steps = tree.select(names), []
    for turn in range(rounds):
        pressed, gone = _compressed(live, block * 8**min(turn, 16), values)
        pressed = written(pressed.select(names), "live")
        rest, leaves = _raked(pressed, values)
        live, splices = written(rest.select(names), "live"), None
        if live.count() <= 1:
            steps.append((gone, leaves, None))
            break
        if (cut := _spliced(live, turn, values)) is not None:
            live, splices = written(cut[0].select(names), "live"), cut[1]
        steps.append((gone, leaves, splices))
    else:
        raise RuntimeError(f"the tree did not contract in {rounds} rounds")
    known = live.select(*NODE, *values)

    def back(known: DataFrame, gone: DataFrame) -> DataFrame:
        """``known`` with the totals of contracted nodes: their survivor's less what stood before them."""
        survivors = known.select(F.col("conv").alias("rconv"), F.col("depth").alias("rdepth"), *[F.col(v).alias(f"_t_{v}") for v in values])
        return known.unionByName(gone.join(survivors, ["rconv", "rdepth"]).select(*NODE, *[(F.col(f"_t_{v}") - F.col(v)).alias(v) for v in values]))

    for gone, leaves, splices in reversed(steps):
        if splices is not None:
            known = written(back(known, splices), "totals")
        known = written(back(known.unionByName(leaves), gone), "totals")
    return known


def member_digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of the nodes with rows in ``ends`` (conv, depth, member): SHA-256 of the members, in order, with commas.

    Members are put together in sorted partitions first, so the task that hashes a node reads strings of thousands.
    """
    order = [*NODE, "member"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(0, batch.num_rows, _IDS):
                conv, depth, member = _columns(batch.slice(place, _IDS), *order)
                starts = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])]))
                told = list(map(str, member.tolist()))
                texts = [",".join(told[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(told)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(conv[starts]), pa.array(depth[starts]), pa.array(member[starts]), pa.array(texts)], [*order, "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if (conv, depth) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({n: pa.array([d[i] for d in done], t) for i, (n, t) in enumerate(zip([*NODE, "ends_sha256"], (pa.int64(), pa.int64(), pa.string()), strict=True))})
        if node:
            yield pa.RecordBatch.from_pydict({"conv": [node[0]], "depth": [node[1]], "ends_sha256": [state.hexdigest()]})

    strings = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, "conv bigint, depth bigint, member bigint, ids string")
    return strings.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(digests, "conv bigint, depth bigint, ends_sha256 string")


def trie_of(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``prefixes``: (conv, depth from 1, k1, k2, p1, p2, chars), ``lengths``: (conv, length), a row a conversation. A
    conversation without turns is a member of the root only; without conversations there is no root and no row.
    """
    lengths, prefixes = written(lengths, "lengths"), written(prefixes, "prefixes")
    hashes = ["depth", "k1", "k2"]
    root, total = lengths.agg(F.min("conv"), F.count("*")).first()
    nodes = written(prefixes.groupBy(hashes).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("p1", "p2", "chars")]), "nodes")
    parents = nodes.select(F.col("conv").alias("pconv"), (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    below = nodes.where("depth > 1").join(parents, ["depth", "p1", "p2"]).unionByName(nodes.where("depth = 1").withColumn("pconv", F.lit(root).cast("bigint")))
    below = written(below.select(*NODE, "pconv", "n_convs", "chars"), "below")
    top = lengths.limit(1).select(F.lit(root).cast("bigint").alias("conv"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("pconv"), F.lit(total).cast("bigint").alias("n_convs"), F.lit(0).cast("bigint").alias("chars"))
    every = below.unionByName(top)
    kids = below.groupBy(F.col("pconv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("kids"))
    tree = every.join(kids, NODE, "left").withColumns({"kids": F.coalesce("kids", F.lit(0)), "pdepth": F.when(F.col("pconv").isNotNull(), F.col("depth") - 1)})
    tree = written(tree.withColumns({"leaves": (F.col("kids") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "tree")
    totals = subtree_totals(tree, ["leaves", "saved"])
    last = prefixes.join(lengths, "conv").where("depth = length").select(*hashes, F.col("conv").alias("member"))
    ends = last.join(nodes.select(*hashes, "conv"), hashes).select(*NODE, "member")
    ends = ends.unionByName(lengths.where("length = 0").select(F.lit(root).cast("bigint").alias("conv"), F.lit(0).cast("bigint").alias("depth"), F.col("conv").alias("member")))
    # every table has a node's row at most once: one shuffle puts them together
    parts = [tree.select(*NODE, "pconv", "n_convs", "kids"), totals, member_digests(ends)]
    union = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    found = union.groupBy(NODE).agg(*[F.max(c).alias(c) for c in ("pconv", "n_convs", "kids", "leaves", "saved", "ends_sha256")])
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("pconv").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of all rebuilt conversations (``numbered_turns``, ``grafted_prefixes``, ``trie_of``).

    Repeated rows are turns of their own; other columns are ignored, whatever their names; an empty table gives no row.
    """
    return trie_of(*grafted_prefixes(numbered_turns(conversations, conv, turn, role, text)))
