"""The trie of conversation prefixes, measured along its Euler tour.

1. Prefixes. A turn is hashed twice to 64 bits together with its place; the prefix of d turns is the exclusive-or of the
   hashes of its turns, a running value that is found in levels of blocks, so a conversation may be of any length. Equal
   prefixes are one node: a hashed aggregation, combined before the shuffle.
2. Tour. Every node has an arc that enters it and one that leaves it. The arc after an entering one enters the first child
   or leaves a node without children; the arc after a leaving one enters the next sibling or leaves the parent. Siblings
   are ordered by their smallest member; the next one is found in a range-partitioned order, so that a node may have any
   number of children.
3. List ranking. Arcs of one conversation follow each other for long stretches, so tasks first join stretches within
   blocks of turns. Then arcs toss coins, and one that shows heads takes over a following one that shows tails; a quarter
   goes in each round, until what is left fits into one group of fixed size. Ranks are handed back round by round. What is
   summed up along the list is the number of arcs, of leaves and of saved tokens.
4. Answers. The leaves and savings below a node are differences of the prefix sums at its two arcs.

The ids of the conversations that end at a node are sorted over all tasks and hashed as a stream of short pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import drop_stored, python_batches, remainder, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations that share their first turns with the first conversation of each so many ids.
FAMILY = 20
HEADS = 4
#: Turns of a conversation in one window, and nodes of a conversation in one block of arcs.
BLOCK = 1 << 12
STRETCH = 1 << 9
#: Arcs in a group that a task ranks by itself.
GROUP = 1 << 15
LAST = 1 << 16
#: Ids in a piece of a list of ids.
PIECE = 4096
SUMS = ("arcs", "leaves", "saved")


def numbered_turns(conversations: DataFrame, *, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, i, g1, g2, words): each turn's place in its conversation, from 0, its two hashes and its number of words.

    Turns are dealt to slices of the whole order, numbered there, and moved up by the turns of earlier slices.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        role.alias("role"),
        F.substring(text, 1, 32).alias("start"),
        F.xxhash64(F.lit(1), role, text).alias("g1"),
        F.xxhash64(F.lit(2), role, text).alias("g2"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("start"), F.asc("g1"), F.asc("row")]
    slices = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    slices = stored(
        slices.select("conv", "g1", "g2", "words", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("at")), "turns"
    )
    # One row for each conversation, and one more for each slice that it is cut by.
    parts = slices.groupBy("conv", "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv", "slice", before.alias("before")).where("before > 0")
    place = F.row_number().over(Window.partitionBy("conv", "slice").orderBy("at")) - 1
    return slices.withColumn("i", place).join(parts, ["conv", "slice"], "left").select(
        "conv", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "g1", "g2", "words"
    )


def shared_heads(turns: DataFrame, ids: DataFrame, *, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """``turns`` (conv, i, ...) of all ``ids`` (conv), rebuilt: the first h = crc32(id) % ``heads`` come from the family's first id."""
    each = ids.select("conv", (F.col("conv") - F.col("conv") % family).alias("base"), remainder("conv", heads).alias("h"))
    first = turns.where((F.col("i") < heads - 1) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    taken = each.join(first, "base").where("i < h")
    shift = taken.groupBy("conv").agg(F.count("*").alias("taken"))
    shift = each.join(shift, "conv", "left").select("conv", "h", (F.col("h") - F.coalesce("taken", F.lit(0))).alias("shift"))
    own = turns.join(shift, "conv").where("i >= h").withColumn("i", F.col("i") - F.col("shift")).drop("h", "shift")
    return own.unionByName(taken.select(*own.columns))


def running_xor(rows: DataFrame, key: str, place: str, values: list[str], levels: int) -> DataFrame:
    """``rows`` with the exclusive-or of each value up to its row, by dense ``place`` (from 0), below BLOCK ** ``levels``."""
    if levels <= 1:
        up_to = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({v: F.bit_xor(v).over(up_to) for v in values})
    block, held = f"_block{levels}", {v: f"_{v}{levels}" for v in values}
    blocks = rows.withColumn(block, F.floor(F.col(place) / BLOCK))
    totals = blocks.groupBy(key, block).agg(*[F.bit_xor(v).alias(v) for v in values])
    after = running_xor(totals, key, block, values, levels - 1)
    before = after.select(key, (F.col(block) + 1).alias(block), *[F.col(v).alias(held[v]) for v in values])
    up_to = Window.partitionBy(key, block).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    inside = blocks.withColumns({v: F.bit_xor(v).over(up_to) for v in values}).join(before, [key, block], "left")
    return inside.withColumns({v: F.col(v).bitwiseXOR(F.coalesce(held[v], F.lit(0))) for v in values}).drop(block, *held.values())


def _levels(n: int) -> int:
    levels = 1
    while BLOCK**levels < n:
        levels += 1
    return levels


def _ranks(after: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, last, before): each arc's first and last in its list, and sums of the arcs before it; after is -1 at an end."""
    n = len(after)
    back = np.arange(n)
    some = np.flatnonzero(after >= 0)
    back[after[some]] = some
    before = np.where((back != np.arange(n))[:, None], sums[back], 0)
    while True:
        further = back[back]
        if (further == back).all():
            break
        before = before + before[back]
        back = further
    last = np.zeros(n, np.int64)
    ends = np.flatnonzero(after < 0)
    last[back[ends]] = ends
    return back, last[back], before


def joined_stretches(arcs: DataFrame, bucket: Column) -> DataFrame:
    """(arc, head, before_*, after, last, *): arcs that follow each other within a bucket make a stretch, named by its first arc.

    ``after`` is the arc that follows the stretch, ``last`` marks its last arc, the other columns are the arcs' own sums.
    """

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        arc = frame["arc"].to_numpy()
        order = np.argsort(arc)
        to = frame["after"].to_numpy()
        at = np.searchsorted(arc, to, sorter=order).clip(max=len(arc) - 1)
        inside = np.where(arc[order[at]] == to, order[at], -1)
        head, last, before = _ranks(inside, frame[list(SUMS)].to_numpy())
        out = {"arc": arc, "head": arc[head]} | {f"before_{s}": before[:, k] for k, s in enumerate(SUMS)}
        return pd.DataFrame(out | {"after": to[last], "last": last == np.arange(len(arc))} | {s: frame[s] for s in SUMS})

    schema = "arc bigint, head bigint, " + ", ".join(f"before_{s} bigint" for s in SUMS) + ", after bigint, last boolean, " + ", ".join(f"{s} bigint" for s in SUMS)
    return arcs.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(join, schema)


def _handed(gone: DataFrame, ranks: DataFrame) -> DataFrame:
    """(arc, before_*) of the arcs of ``gone`` from the ranks of their heads."""
    ahead = ranks.select(F.col("arc").alias("head"), *[F.col(f"before_{s}").alias(f"head_{s}") for s in SUMS])
    return gone.join(ahead, "head").select("arc", *[(F.col(f"head_{s}") + F.col(f"before_{s}")).alias(f"before_{s}") for s in SUMS])


def list_ranks(arcs: DataFrame, block: list[str]) -> DataFrame:
    """(arc, before_*): sums of the arcs before each one of the list (arc, after, sums, and the columns of ``block``).

    ``after`` is -1 behind the last arc. ``block`` names a bounded group of arcs that tend to follow each other.
    """
    n = arcs.count()
    bucket = F.pmod(F.xxhash64(*block), F.lit(max(1, -(-n // GROUP))))
    stretches = stored(joined_stretches(arcs, bucket), "stretches")
    total = [(F.col(f"before_{s}") + F.col(s)).alias(s) for s in SUMS]
    left = stored(stretches.where("last").select(F.col("head").alias("arc"), "after", *total), "arcs")
    taken: list[DataFrame] = []
    while left.count() > LAST:
        # Heads takes over the arc after it if that shows tails.
        coin = left.withColumn("tails", F.pmod(F.xxhash64("arc", F.lit(len(taken))), F.lit(2)) == 1)
        tails = coin.where("tails").select(F.col("arc").alias("after"), F.col("after").alias("then"), *[F.col(s).alias(f"then_{s}") for s in SUMS])
        met = stored(coin.join(tails, "after", "left").withColumn("takes", ~F.col("tails") & F.col("then").isNotNull()), "met")
        gone = met.where("takes").select(F.col("after").alias("arc"), F.col("arc").alias("head"), *[F.col(s).alias(f"before_{s}") for s in SUMS])
        taken.append(stored(gone, "taken"))
        kept = met.join(taken[-1].select("arc"), "arc", "left_anti").select(
            "arc", F.when(F.col("takes"), F.col("then")).otherwise(F.col("after")).alias("after"),
            *[F.when(F.col("takes"), F.col(s) + F.col(f"then_{s}")).otherwise(F.col(s)).alias(s) for s in SUMS],
        )
        before, left = left, stored(kept, "arcs")
        drop_stored(before, met)
    ranks = joined_stretches(left, F.lit(0)).select("arc", *[f"before_{s}" for s in SUMS])
    for gone in reversed(taken):
        ranks = stored(_handed(gone, ranks).unionByName(ranks), "ranks")
    return stored(_handed(stretches, ranks), "ranks")


def next_siblings(nodes: DataFrame) -> DataFrame:
    """(node, next): the following node in the order of (parent, conv_id) with the same parent, or null.

    Rows are sorted over all tasks; each slice of the order looks to the first row of the next one.
    """
    order = ["parent", "conv_id"]
    slices = nodes.select("node", *order).repartitionByRange(*order).sortWithinPartitions(*order)
    slices = stored(slices.withColumn("slice", F.spark_partition_id()), "siblings")
    within = Window.partitionBy("slice").orderBy(*order)
    follow = F.struct("parent", "node")
    # One row for each slice.
    first = slices.groupBy("slice").agg(F.min(F.struct(*order, "node")).alias("f"))
    first = first.select("slice", F.lead(F.struct("f.parent", "f.node")).over(Window.orderBy("slice")).alias("over"))
    seen = slices.withColumn("follow", F.lead(follow).over(within)).join(first, "slice", "left")
    seen = seen.withColumn("follow", F.coalesce("follow", "over"))
    return seen.select("node", F.when(F.col("follow.parent") == F.col("parent"), F.col("follow.node")).alias("next"))


def id_digests(ends: DataFrame) -> DataFrame:
    """(d, x1, x2, sha): SHA-256 of the comma-joined, ascending ids of (conv, d, x1, x2) of each node (d, x1, x2).

    Ids are sorted over all tasks, a node's ids over several if need be, and joined to pieces of PIECE ids at most; the
    pieces of a node are hashed one by one, so a task holds one piece however many ids a node has.
    """
    key = ["d", "x1", "x2"]
    order = [*key, "conv"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(key, node)) | {"first": held[0], "ids": ",".join(map(str, held))}], schema)

        schema = pa.schema([("d", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        node, held = None, []
        for batch in batches:
            out = []
            for d, x1, x2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((d, x1, x2) != node or len(held) == PIECE):
                    out.append(piece())
                    held = []
                node = (d, x1, x2)
                held.append(conv)
            yield from out
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*key, "sha"]
        node, running = None, None
        for batch in python_batches(batches):
            out = []
            for d, x1, x2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, x1, x2) == node:
                    running.update(b",")
                else:
                    if node:
                        out.append((*node, running.hexdigest()))
                    node, running = (d, x1, x2), hashlib.sha256()
                running.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, running.hexdigest())], names)

    dealt = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = dealt.mapInArrow(join, "d bigint, x1 bigint, x2 bigint, first bigint, ids string")
    dealt = pieces.repartition(*key).sortWithinPartitions(*key, "first")
    return dealt.mapInArrow(digest, "d bigint, x1 bigint, x2 bigint, sha string")


def prefix_trie(
    conversations: DataFrame,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    family: int | None = None,
    heads: int = HEADS,
) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter, leave).

    ``enter`` and ``leave`` are the places of the node's arcs in the tour, from 0. With ``family`` the conversations are
    rebuilt first (``shared_heads``).

    * Null roles and texts are empty ones. Rows without a conversation id are left out. An empty table gives no rows.
    * Turns follow their number, null first; those with equal numbers their role, then the first 32 characters of the text,
      then a hash of it. Repeated rows are turns of their own.
    * Conversations and texts may be of any length, nodes may have any number of members and children. Other columns are
      not read.
    """
    turns = stored(numbered_turns(conversations, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col), "numbered")
    ids = turns.select("conv").distinct()
    if family:
        turns = stored(shared_heads(turns, ids, family=family, heads=heads), "rebuilt")
    longest = turns.agg(F.max("i")).first()[0]
    salted = turns.withColumns({"y1": F.xxhash64("g1", "i"), "y2": F.xxhash64("g2", "i"), "w": F.col("words")})
    salted = salted.select("conv", "i", "words", "y1", "y2", F.col("y1").alias("x1"), F.col("y2").alias("x2"))
    marked = stored(running_xor(salted, "conv", "i", ["x1", "x2"], _levels((longest or 0) + 1)).withColumn("d", F.col("i") + 1), "prefixes")

    # Nodes without the root.
    nodes = marked.groupBy("d", "x1", "x2").agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("words").alias("words"),
        F.min(F.col("x1").bitwiseXOR(F.col("y1"))).alias("p1"), F.min(F.col("x2").bitwiseXOR(F.col("y2"))).alias("p2"),
    )
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id() + 1), "nodes")
    root = stored(
        ids.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0").select(
            F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("x1"), F.lit(0).cast("bigint").alias("x2"), "n_convs", "conv_id",
            F.lit(0).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("bigint").alias("parent_conv_id"),
        ), "root",
    )
    # The root's children, which may be half of all nodes, need no join.
    top = nodes.where("d = 1").join(F.broadcast(root.select(F.lit(1).cast("bigint").alias("d"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))), "d")
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    lower = nodes.where("d > 1").join(above, ["d", "p1", "p2"])
    names = ["d", "x1", "x2", "n_convs", "conv_id", "words", "node", "parent", "parent_conv_id"]
    tree = stored(top.select(*names).unionByName(lower.select(*names)).unionByName(root.select(*names)), "tree")

    children = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.min_by("node", "conv_id").alias("child"))
    linked = tree.join(children, "node", "left").join(next_siblings(tree.where("parent is not null")), "node", "left")
    linked = stored(linked.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")), "linked")

    def arc(node: Column, leaving: int) -> Column:
        return node * 2 + leaving

    own, none = F.col("node"), F.lit(0).cast("bigint")
    block = [F.col("conv_id").alias("conv_id"), F.floor(F.col("d") / STRETCH).alias("part")]
    entering = linked.select(
        arc(own, 0).alias("arc"), F.when(F.col("child").isNull(), arc(own, 1)).otherwise(arc(F.col("child"), 0)).alias("after"),
        F.lit(1).cast("bigint").alias("arcs"), (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), *block,
    )
    follows = F.when(F.col("next").isNotNull(), arc(F.col("next"), 0)).when(F.col("parent").isNotNull(), arc(F.col("parent"), 1)).otherwise(F.lit(-1))
    leaving = linked.select(arc(own, 1).alias("arc"), follows.alias("after"), F.lit(1).cast("bigint").alias("arcs"), none.alias("leaves"), none.alias("saved"), *block)
    ranks = list_ranks(stored(entering.unionByName(leaving), "tour"), ["conv_id", "part"])
    at = ranks.groupBy(F.floor(F.col("arc") / 2).alias("node")).agg(
        *[F.max(F.when(F.col("arc") % 2 == side, F.col(f"before_{s}"))).alias(f"{s}_{side}") for s in SUMS for side in (0, 1)]
    )

    ends = marked.groupBy("conv").agg(F.max_by(F.struct("d", "x1", "x2"), "d").alias("e"))
    zero = F.lit(0).cast("bigint")
    ends = ids.join(ends, "conv", "left").select("conv", *[F.coalesce(F.col(f"e.{c}"), zero).alias(c) for c in ("d", "x1", "x2")])
    empty = hashlib.sha256().hexdigest()
    return (
        linked.join(at, "node").join(id_digests(ends), ["d", "x1", "x2"], "left").select(
            "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children",
            (F.col("leaves_1") - F.col("leaves_0")).alias("n_leaves"), (F.col("saved_1") - F.col("saved_0")).alias("saved_tokens"),
            F.coalesce("sha", F.lit(empty)).alias("ends_sha256"), F.col("arcs_0").alias("enter"), F.col("arcs_1").alias("leave"),
        )
    )
