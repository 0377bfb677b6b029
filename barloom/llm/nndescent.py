"""Near duplicates among embeddings by NN-descent.

1. Leaders. Vectors within half the linking angle of one leader are linked with each other for certain, so they form a
   class that the graph sees as one point. Classes are grown over several rounds in small groups of neighbouring vectors;
   a group of very many near copies shrinks by the size of a group in each.
2. Graph. Each leader starts with its nearest ones among its neighbours along several orders by random planes, and refines
   them by joins with its neighbours' neighbours. A neighbour counts if the two classes are near enough to hold links. A
   list in which all count is saturated: it is lengthened and refined again until none is.
3. Links. Class pairs that are near enough link as a whole, or not at all; those between are compared member by member
   in blocks. Counts, not pairs, leave the tasks.
4. Audit. A fixed number of vectors is compared with all rows, and recall is taken vector by vector, those with few and
   with many links apart. Where it falls short lists are lengthened; labels that still fall short are compared exactly, in
   blocks of leaders.

Groups are cut from a sorted order: rows are range-partitioned by what brings them together and then by a hash, and tasks
take them in runs of bounded size. What is cut apart in one round meets in another.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import components, drop_stored, stored

THRESHOLD = 0.93
NEIGHBOURS = 8
#: How much longer a saturated list gets.
GROWTH = 4
ROUNDS = 2
ORDERS = 3
#: Vectors that meet in a group.
GROUP = 192
PLANES = 24
LEADER_ROUNDS = 6
MEMBERS = 1024
AUDIT_VECTORS = 512
AUDIT_RECALL = 0.98
AUDIT_ROUNDS = 3
#: Vectors with more links are audited apart.
MANY_LINKS = 32
EDGE = 1e-9


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(row, id, part, vec): unit vectors as bytes, ``part`` the label and length; ``vec`` null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, out = [], []
            for vec, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                unit = None
                if vec and label is not None and None not in vec:
                    x = np.asarray(vec, np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        x = x / top
                        unit = (x / np.linalg.norm(x)).tobytes()
                parts.append(f"{label}/{len(vec)}" if unit else None)
                out.append(unit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(parts, pa.string()), pa.array(out, pa.binary())], ["id", "part", "vec"]
            )

    picked = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col), F.col(label_col).cast("string"))
    return picked.mapInArrow(run, "id bigint, part string, vec binary").withColumn("row", F.monotonically_increasing_id())


def _cut(frames: Iterator[pd.DataFrame], key: str, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``fn`` of runs of rows that follow each other and have equal ``key``, of at most GROUP rows."""
    held = None
    for frame in itertools.chain(frames, [None]):
        if frame is not None and not len(frame):
            continue
        both = held if frame is None else frame if held is None else pd.concat([held, frame], ignore_index=True)
        if both is None:
            return
        keys = both[key].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        cuts = [at for a, b in zip(starts, [*starts[1:], len(both)]) for at in range(a, b, GROUP)]
        ends = [*cuts[1:], len(both)]
        if frame is not None:  # the last run may go on
            held = both.iloc[cuts[-1] :]
            cuts, ends = cuts[:-1], ends[:-1]
        out = [fn(both.iloc[a:b]) for a, b in zip(cuts, ends)]
        if out:
            yield pd.concat(out, ignore_index=True)


def in_orders(points: DataFrame, seeds: list[int], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` of groups of ``points`` (row, part, vec, ...): runs of a part in an order by the signs on random planes, one for each seed."""

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for frame in frames:
            lengths = frame["vec"].map(len).to_numpy() // 8
            codes = np.zeros((len(seeds), len(frame)), np.int64)
            for n in np.unique(lengths):
                if n not in planes:
                    planes[n] = np.stack([np.random.default_rng([seed, n]).normal(size=(n, PLANES)) for seed in seeds])
                own = lengths == n
                signs = _matrix(frame["vec"][own]) @ planes[n] > 0
                codes[:, own] = signs @ (1 << np.arange(PLANES)[::-1])
            for seed, row in zip(seeds, codes):
                yield frame.assign(lane=f"{seed}/" + frame["part"], code=row)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    coded = points.mapInPandas(code, f"{fields}, lane string, code bigint").withColumn("mix", F.xxhash64("row", "lane"))
    order = ["lane", "code", "mix"]
    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(lambda frames: _cut(frames, "lane", fn), schema)


def leaders(points: DataFrame, cosine: float) -> DataFrame:
    """(row, part, vec, leader, cos) for every point: leaders lead themselves, others are within ``cosine`` of their leader."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        near = _matrix(frame["vec"])
        near = near @ near.T >= cosine
        rows, vecs, head = frame["row"].to_numpy(), frame["vec"].to_numpy(), np.full(len(frame), -1)
        for i in range(len(rows)):
            if head[i] < 0:
                head[near[i] & (head < 0)] = i
                head[i] = i
        moved = np.flatnonzero(head != np.arange(len(rows)))
        return pd.DataFrame({"leader": rows[moved], "to": rows[head[moved]], "lead": vecs[head[moved]]})

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = frame["lead"].notna().to_numpy()
            cos = np.full(len(frame), np.nan)
            for at in np.flatnonzero(asked):
                cos[at] = np.frombuffer(frame["vec"].iat[at]) @ np.frombuffer(frame["lead"].iat[at])
            yield frame.drop(columns="lead").assign(near=np.where(asked, cos, -2.0))

    members = points.select("row", "part", "vec", F.col("row").alias("leader"), F.lit(1.0).alias("cos"))
    count, written = points.count(), None
    for turn in range(LEADER_ROUNDS):
        heads = members.where("row = leader").select("row", "part", "vec")
        moved = stored(in_orders(heads, [100 + turn], choose, "leader bigint, to bigint, lead binary"), "moved")
        fewer = moved.count()
        if not fewer:
            break
        schema = "row bigint, part string, vec binary, leader bigint, cos double, to bigint, near double"
        placed = stored(members.join(moved, "leader", "left").select("row", "part", "vec", "leader", "cos", "to", "lead").mapInPandas(measure, schema), "placed")
        # A head stays with those of its members that don't fit the new leader.
        stays = placed.where(F.col("to").isNotNull() & (F.col("near") < cosine)).select("leader", F.lit(True).alias("stays")).distinct()
        moves = F.col("to").isNotNull() & (F.col("near") >= cosine) & ((F.col("row") != F.col("leader")) | F.col("stays").isNull())
        members = stored(
            placed.join(stays, "leader", "left").select(
                "row", "part", "vec", F.when(moves, F.col("to")).otherwise(F.col("leader")).alias("leader"), F.when(moves, F.col("near")).otherwise(F.col("cos")).alias("cos")
            ),
            "members",
        )
        drop_stored(moved, placed, *[written] if written is not None else [])
        written = members
        if fewer < 0.02 * count:
            break
        count -= fewer
    return members


def _counts(s: np.ndarray, wide: np.ndarray, reach: float) -> np.ndarray:
    """Which pairs of leaders with cosines ``s`` are near enough that their classes may hold links."""
    return np.arccos(np.clip(s, -1, 1)) <= reach + wide[:, None] + wide[None, :]


def _pairs(rows: np.ndarray, s: np.ndarray, counts: np.ndarray, k: np.ndarray) -> pd.DataFrame:
    """(u, v, s, counts): the best ``k`` of each row; below -1 there is none."""
    order = np.argsort(-s, axis=1, kind="stable")
    keep = (np.arange(len(rows))[None, :] < k[:, None]) & (np.take_along_axis(s, order, 1) >= -1.5)
    a, at = np.nonzero(keep)
    b = order[a, at]
    return pd.DataFrame({"u": rows[a], "v": rows[b], "s": s[a, b], "counts": counts[a, b]})


EDGES = "u bigint, v bigint, s double, counts boolean"


def _best(edges: DataFrame, size: Column) -> DataFrame:
    """The best ``size`` edges (u, v, s, counts) of each u, each v once."""
    once = edges.groupBy("u", "v", *[c for c in edges.columns if c == "k"]).agg(F.max("s").alias("s"), F.max("counts").alias("counts"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return once.withColumn("rank", rank).where(F.col("rank") <= size).select("u", "v", "s", "counts")


def first_graph(heads: DataFrame, reach: float) -> DataFrame:
    """(u, v, s, counts): the nearest leaders of each u in its groups of ORDERS orders."""

    def nearest(frame: pd.DataFrame) -> pd.DataFrame:
        cos = _matrix(frame["vec"])
        cos = cos @ cos.T
        np.fill_diagonal(cos, -2)
        return _pairs(frame["row"].to_numpy(), cos, _counts(cos, frame["wide"].to_numpy(), reach), np.full(len(frame), NEIGHBOURS))

    return _best(in_orders(heads, list(range(ORDERS)), nearest, EDGES), F.lit(NEIGHBOURS))


def refine(heads: DataFrame, graph: DataFrame, sizes: DataFrame, turn: int, reach: float, active: DataFrame | None = None) -> DataFrame:
    """One round: neighbours of each leader (either way) meet, and keep the better of each other.

    ``sizes`` (u, k) has the list lengths that are not NEIGHBOURS. A large neighbourhood is cut anew at every leader and in
    every ``turn``. With ``active`` (u) only the neighbourhoods of these leaders meet.
    """

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("row")
        cos = _matrix(frame["vec"])
        cos = cos @ cos.T
        np.fill_diagonal(cos, -2)
        counts = _counts(cos, frame["wide"].to_numpy(), reach)
        cos[cos <= frame["last"].to_numpy()[:, None]] = -2
        return _pairs(frame["row"].to_numpy(), cos, counts, frame["k"].to_numpy())

    lists = graph.groupBy("u").agg(F.count("*").alias("held"), F.min("s").alias("least")).join(sizes, "u", "left")
    size = F.coalesce("k", F.lit(NEIGHBOURS))
    lists = lists.select(F.col("u").alias("row"), size.alias("k"), F.when(F.col("held") >= size, F.col("least")).otherwise(-2.0).alias("last"))
    known = heads.select("row", "vec", "wide").join(lists, "row", "left").na.fill({"k": NEIGHBOURS, "last": -2.0})
    ends = graph.select(F.col("u").alias("at"), F.col("v").alias("row")).unionByName(graph.select(F.col("v").alias("at"), F.col("u").alias("row")))
    ends = ends.unionByName(heads.select(F.col("row").alias("at"), "row"))
    if active is not None:
        ends = ends.join(active.select(F.col("u").alias("at")), "at", "left_semi")
    met = ends.join(known, "row").withColumn("mix", F.xxhash64("row", "at", F.lit(turn)))
    met = met.repartitionByRange("at", "mix").sortWithinPartitions("at", "mix").mapInPandas(lambda frames: _cut(frames, "at", meet), EDGES)
    return _best(graph.unionByName(met).join(sizes, "u", "left"), size)


def all_edges(heads: DataFrame, reach: float) -> DataFrame:
    """(u, v, s, counts) of all pairs of ``heads`` of one part that count, by comparing blocks of leaders with each other."""
    blocks = heads.drop("size").join(heads.groupBy("part").agg(F.count("*").alias("size")), "part")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / MEMBERS)))
    blocks = blocks.groupBy("part", "block").agg(F.collect_list(F.struct("row", "vec", "wide")).alias("x"))
    blocks = stored(blocks.select("part", "block", F.col("x.row").alias("rows"), F.col("x.vec").alias("vecs"), F.col("x.wide").alias("wides")), "blocks")
    other = blocks.select("part", F.col("block").alias("to"), F.col("rows").alias("b_rows"), F.col("vecs").alias("b_vecs"), F.col("wides").alias("b_wides"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame.itertuples():
                cos = _matrix(x.vecs) @ _matrix(x.b_vecs).T
                near = np.arccos(np.clip(cos, -1, 1)) <= reach + np.asarray(x.wides)[:, None] + np.asarray(x.b_wides)[None, :]
                a, b = np.nonzero(near & (np.asarray(x.rows)[:, None] != np.asarray(x.b_rows)[None, :]))
                yield pd.DataFrame({"u": np.asarray(x.rows)[a], "v": np.asarray(x.b_rows)[b], "s": cos[a, b], "counts": np.ones(len(a), bool)})

    return blocks.join(other, "part").where("block <= to").drop("part", "block", "to").mapInPandas(run, EDGES)


def _pair_counts(pairs: DataFrame, chunks: DataFrame, threshold: float) -> DataFrame:
    """(row, n, a, b): links of each member with the members of the other class, for class pairs (a, b)."""
    left = chunks.select(F.col("leader").alias("a"), F.col("rows").alias("ar"), F.col("vecs").alias("av"))
    right = chunks.select(F.col("leader").alias("b"), F.col("rows").alias("br"), F.col("vecs").alias("bv"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, n, a, b = [], [], [], []
            for x in frame.itertuples():
                linked = _matrix(x.av) @ _matrix(x.bv).T >= threshold
                for ids, count in ((x.ar, linked.sum(axis=1)), (x.br, linked.sum(axis=0))):
                    some = np.flatnonzero(count)
                    rows += np.asarray(ids)[some].tolist()
                    n += count[some].tolist()
                    a += [x.a] * len(some)
                    b += [x.b] * len(some)
            yield pd.DataFrame({"row": rows, "n": n, "a": a, "b": b}, dtype="int64")

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(run, "row bigint, n bigint, a bigint, b bigint")


def _links(members: DataFrame, heads: DataFrame, graph: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((row, leader, n_links), (a, b) links between leaders), from the graph of leaders."""
    angle = math.acos(threshold)
    pairs = graph.where("counts").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.max("s").alias("s"))
    for side in "ab":
        pairs = pairs.join(heads.select(F.col("row").alias(side), F.col("size").alias(f"{side}n"), F.col("wide").alias(f"{side}w")), side)
    apart, around = F.acos(F.least("s", F.lit(1.0))), F.col("aw") + F.col("bw")
    single = (F.col("an") == 1) & (F.col("bn") == 1)
    how = F.when(single, (F.col("s") >= threshold).cast("int")).when(apart + around <= angle - EDGE, 1).otherwise(2)
    pairs = stored(pairs.withColumn("how", how).where("how > 0"), "pairs")
    sure, open_ = pairs.where("how = 1"), pairs.where("how = 2")
    whole = sure.select(F.col("a").alias("leader"), F.col("bn").alias("n")).unionByName(sure.select(F.col("b").alias("leader"), F.col("an").alias("n")))
    whole = whole.groupBy("leader").agg(F.sum("n").alias("whole"))
    sized = members.join(heads.select(F.col("row").alias("leader"), "size"), "leader")
    asked = open_.select(F.col("a").alias("leader")).unionByName(open_.select(F.col("b").alias("leader"))).distinct()
    chunk = F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / MEMBERS))
    chunks = (
        sized.join(asked, "leader").groupBy("leader", chunk.alias("chunk")).agg(F.collect_list(F.struct("row", "vec")).alias("x"))
        .select("leader", F.col("x.row").alias("rows"), F.col("x.vec").alias("vecs"))
    )
    counted = stored(_pair_counts(open_, chunks, threshold), "pair-counts")
    by_row = counted.groupBy("row").agg(F.sum("n").alias("single"))
    total = F.col("size") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("single", F.lit(0))
    n_links = sized.select("row", "leader", "size").join(whole, "leader", "left").join(by_row, "row", "left").select("row", "leader", total.alias("n_links"))
    joined = stored(sure.select("a", "b").unionByName(counted.select("a", "b")).distinct(), "class-links")
    n_links = stored(n_links, "link-counts")
    drop_stored(pairs, counted)
    return n_links, joined


def _audit(vectors: DataFrame, threshold: float) -> dict[int, tuple[str, int]]:
    """{row: (part, links)} of AUDIT_VECTORS vectors (the lowest hashes) by comparison with all rows, a batch at a time."""
    asked = vectors.orderBy(F.xxhash64("row"), "row").limit(AUDIT_VECTORS).select("row", "part", "vec").collect()
    by_part: dict[str, list] = {}
    for r in asked:
        by_part.setdefault(r["part"], []).append((r["row"], np.frombuffer(bytes(r["vec"]), np.float64)))
    shared = vectors.sparkSession.sparkContext.broadcast(by_part)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, n = [], []
            for part, own in frame.groupby("part"):
                queries = shared.value.get(part)
                if queries:
                    linked = np.stack([q for _, q in queries]) @ _matrix(own["vec"]).T >= threshold
                    rows += [r for r, _ in queries]
                    n += linked.sum(axis=1).tolist()
            yield pd.DataFrame({"row": rows, "n": n}, dtype="int64")

    sums = vectors.select("part", "vec").mapInPandas(run, "row bigint, n bigint").groupBy("row").agg(F.sum("n").alias("n"))
    parts = {r["row"]: r["part"] for r in asked}
    return {r["row"]: (parts[r["row"]], r["n"] - 1) for r in sums.collect()}


def _short(truth: dict[int, tuple[str, int]], found: dict[int, int]) -> set[str]:
    """The parts with audited vectors whose links are not all found, if vectors with few, or with many, find too few of them on average."""
    low: set[str] = set()
    for many in (False, True):
        shares = {r: min(found[r], n) / n for r, (_, n) in truth.items() if n and (n > MANY_LINKS) == many}
        if shares and sum(shares.values()) < AUDIT_RECALL * len(shares):
            low |= {truth[r][0] for r, x in shares.items() if x < 1}
    return low


def near_duplicates(
    rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``rows``: (id_col, n_links, component_id, kept).

    Vectors are compared within equal labels (and equal lengths) only.

    * Null labels, null, empty and zero vectors, and null or non-finite components: no links, a component of its own.
    * Repeated rows are vectors of their own that link with each other. A null id is never a component_id unless all ids
      of the component are null; such rows are not ``kept``.
    * Leaders are the first of their group in the order by planes and a hash; of equally near neighbours the one with the
      lower row number is kept. Neither changes which links are true, only in which round they are found.
    * An empty table gives no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    everything = stored(unit_vectors(rows, id_col, vec_col, label_col), "vectors")
    vectors = everything.where("vec is not null").select("row", "part", "vec")
    angle = math.acos(threshold)
    reach = angle + EDGE
    # Half the angle, and a little less for rounding.
    members = leaders(vectors, math.cos(angle / 2 - EDGE))
    classes = members.groupBy("leader").agg(F.count("*").alias("size"), F.acos(F.least(F.min("cos"), F.lit(1.0))).alias("wide"))
    own = members.where("row = leader").select("row", "part", "vec")
    heads = stored(own.join(classes.withColumnRenamed("leader", "row"), "row").withColumn("wide", F.when(F.col("size") > 1, F.col("wide")).otherwise(0.0)), "leaders")
    graph = stored(first_graph(heads, reach), "graph")
    sizes = spark.createDataFrame([], "u bigint, k int")
    truth = _audit(vectors, threshold)
    turns = itertools.count()

    def better(graph: DataFrame, active: DataFrame | None = None) -> DataFrame:
        after = stored(refine(heads, graph, sizes, next(turns), reach, active), "graph")
        drop_stored(graph)
        return after

    def settled(graph: DataFrame, active: DataFrame | None = None) -> DataFrame:
        """Refined until a round adds no pair that counts."""
        held = -1
        while held < (now := graph.where("counts").count()):
            held, graph = now, better(graph, active)
        return graph

    for _ in range(ROUNDS - 1):
        graph = better(graph)
    graph = settled(graph)
    for turn in range(AUDIT_ROUNDS):
        while True:
            full = graph.groupBy("u").agg(F.count("*").alias("held"), F.bool_and("counts").alias("all")).where("all").join(sizes, "u", "left")
            full = full.where(F.col("held") >= F.coalesce("k", F.lit(NEIGHBOURS))).select("u", (F.col("held") * GROWTH).cast("int").alias("k"))
            full = stored(full, "full")
            if full.isEmpty():
                break
            sizes = stored(full.unionByName(sizes.join(full, "u", "left_anti")), "sizes")
            # Longer lists are filled where they, or their neighbours, are; the rest of the graph has settled.
            around = graph.join(full.select("u"), "u", "left_semi").select(F.col("v").alias("u"))
            graph = settled(graph, stored(full.select("u").unionByName(around).distinct(), "around"))
        n_links, joined = _links(members, heads, graph, threshold)
        asked = spark.createDataFrame([(r,) for r in truth], "row bigint")
        found = {r["row"]: r["n_links"] for r in n_links.join(F.broadcast(asked), "row").collect()}
        low = _short(truth, found)
        if not low:
            break
        if turn < AUDIT_ROUNDS - 1:
            longer = heads.where(F.col("part").isin(*low)).select(F.col("row").alias("u")).join(sizes, "u", "left")
            longer = longer.select("u", (F.coalesce("k", F.lit(NEIGHBOURS)) * GROWTH).cast("int").alias("k"))
            sizes = stored(longer.unionByName(sizes.join(longer, "u", "left_anti")), "sizes")
            graph = settled(better(graph))
        else:
            exact = all_edges(heads.where(F.col("part").isin(*low)), reach)
            n_links, joined = _links(members, heads, stored(graph.unionByName(exact), "graph"), threshold)
    groups = components(joined)
    by_group = n_links.join(groups.withColumnRenamed("node", "leader"), "leader", "left").select(
        "row", "n_links", F.coalesce("component", "leader").alias("component")
    )
    labelled = everything.select("row", "id").join(by_group, "row", "left").withColumn("component", F.coalesce("component", "row"))
    least = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    return labelled.join(least, "component").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
