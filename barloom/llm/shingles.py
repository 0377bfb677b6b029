"""Near copies among texts: SimHash links and MinHash keys propose, the exact Jaccard similarity of word shingles decides.

1. Sketch. A text is the set of its word shingles, each as a 64-bit hash. Texts with equal sets are one node throughout.
   A node has the SimHash fingerprint of its set, and BANDS keys of ROWS minima each; two sets of similarity s share a
   key with probability 1 - (1 - s^ROWS)^BANDS, so that a pair at 0.8 is missed once in some eight million.
2. SimHash. Fingerprints meet at the anchors of ``simhash``, whose links are compared. Two bits are a strict test (sets
   at 0.8 differ in some ten bits of 64), so this finds the closest copies, and the keys the rest.
3. Leaders. Each node is compared with one other: of the nodes that lead one of its keys, the one that shares keys with
   most others. In a family of copies that is the text they were made from. Then, for a few rounds, each component is
   compared with one other. The similarity of a pair is computed from the sets themselves; only that links. A large
   group of near copies costs a comparison a member in a round, however many keys it shares.
4. Rest. Nodes that share a key with another component are looked through exactly. The shingles of each are put in one
   order, those of one component only first and then the rarest: similar sets meet in a shingle that stands so early in
   both that enough follow it, so a copy with too many shingles of its own meets nobody. Of the nodes at a shingle, those
   of the smallest components are compared with all of later ones that the places and sizes allow, one component at first,
   then the next 16, the next 256 and so on, and never where both are already in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import simhash
from barloom.llm.common import components, drop_stored, python_batches, stored

WORDS = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 5
LEADER_ROUNDS = 3
SEED = 42
BLOCK = 1 << 12

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_MIX = _random.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)
_BAND = _random.integers(0, 1 << 64, BANDS, np.uint64)


def shingles(text: bytes | None, words_per_shingle: int = WORDS) -> np.ndarray:
    """The sorted different hashes of a UTF-8 text's shingles; a shorter text is one shingle, a blank one has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(words_per_shingle, len(words))
    hashed = map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, zip(*(words[i:] for i in range(k)))))
    return np.unique(np.fromiter(hashed, np.uint64, len(words) - k + 1))


def bands(grams: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; none for an empty set."""
    if not len(grams):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), BLOCK):
        np.minimum(least, (grams[None, at : at + BLOCK] * _FACTORS + _SHIFTS).min(axis=1), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND


def _node(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _fingerprint(grams: np.ndarray) -> int:
    """SimHash of a set: each different shingle has one vote."""
    return simhash.majority((grams[at : at + simhash.BLOCK] for at in range(0, len(grams), simhash.BLOCK)), len(grams))


def sketches(docs: DataFrame, words_per_shingle: int, *, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, node, n, fp, bands): a hash of the text, the set's hash, its size, fingerprint and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in python_batches(batches):
            sets = [shingles(t, words_per_shingle) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            out = [
                *batch.columns[:2],
                pa.array([_node(x) for x in sets], pa.int64()),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array(np.array([_fingerprint(x) for x in sets], np.uint64).view(np.int64)),
                pa.array([bands(x).view(np.int64) for x in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(out, ["id", "text_hash", "node", "n", "fp", "bands"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id bigint, text_hash bigint, node bigint, n bigint, fp bigint, bands array<bigint>")


def _sets(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """(node, grams) of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in python_batches(batches):
            sets = [shingles(t, words_per_shingle) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            out = [pa.array([_node(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["node", "grams"])

    return docs.select("text").mapInArrow(run, "node bigint, grams binary")


def _held(sets: DataFrame) -> DataFrame:
    """(node, component, gram): one row for each shingle of (node, component, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in python_batches(batches):
            grams = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            sizes = [len(x) for x in grams]
            ends = [np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes) for i in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*ends, np.concatenate(grams))], ["node", "component", "gram"])

    return sets.select("node", "component", "grams").mapInArrow(run, "node bigint, component bigint, gram bigint")


def simhash_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that join every (node, n, fp) with those whose fingerprints differ in two bits or less; at most 32 a node."""
    nodes = nodes.where("n > 0").select("node", "fp")
    distinct = stored(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    equal = nodes.join(distinct, "fp").where("rep <> node").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return simhash.links(distinct).unionByName(equal)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are at least so similar."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame["x"], frame["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield frame.loc[keep, ["a", "b"]]

    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(run, "a bigint, b bigint")


class _Search:
    """Links among ``asked`` (node, n) with ``keys`` (node, band), and the components that they make so far: ``groups`` (node, component)."""

    def __init__(self, asked: DataFrame, keys: DataFrame, sets: DataFrame, similarity: float):
        spark = asked.sparkSession
        self.sizes = asked.select("node", "n")
        self.keys = keys
        self.sets, self.similarity = sets, similarity
        self.tried = spark.createDataFrame([], "a bigint, b bigint")
        self.groups = spark.createDataFrame([], "node bigint, component bigint")

    def compare(self, pairs: DataFrame) -> None:
        """Compare the different (a, b) that are alike in size and were not compared before."""
        for side in "ab":
            pairs = pairs.join(self.sizes.select(F.col("node").alias(side), F.col("n").alias(f"{side}n")), side)
        alike = F.least("an", "bn") >= self.similarity * F.greatest("an", "bn") - 1e-9
        pairs = pairs.where(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = stored(pairs.join(self.tried, ["a", "b"], "left_anti"), "compared")
        if pairs.isEmpty():
            return
        self.tried = self.tried.unionByName(pairs)
        found = stored(_similar(pairs, self.sets, self.similarity), "similar")
        if not found.isEmpty():
            # The components so far stand for the links before.
            known = self.groups.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
            before, self.groups = self.groups, stored(components(known.unionByName(found)), "groups")
            drop_stored(before)
        drop_stored(found)

    def _named(self) -> DataFrame:
        """(band, node, component) of all keys."""
        named = self.keys.join(self.groups, "node", "left")
        return named.select("band", "node", F.coalesce("component", "node").alias("component"))

    def _open(self, named: DataFrame) -> DataFrame:
        """(band) of the keys whose members are in several components."""
        ends = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        return ends.where("low < high").select("band")

    def ask_leaders(self, turn: int) -> None:
        """Compare each component with one other in its open keys."""
        named = self._named()
        # One member speaks for all of a component in a key.
        spoken = named.groupBy("band", "component").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("node"))
        spoken = stored(spoken.join(self._open(named), "band"), "spoken")
        first = spoken.groupBy("band").agg(F.min(F.struct(F.xxhash64("component", F.lit(turn)).alias("order"), "component", "node")).alias("first"))
        asking = spoken.join(first, "band").where(F.col("component") != F.col("first.component"))
        pairs = asking.groupBy("component").agg(F.min(F.struct("first.order", F.col("first.node").alias("a"), F.col("node").alias("b"))).alias("p"))
        self.compare(pairs.select("p.a", "p.b"))
        drop_stored(spoken)

    def _most(self, n: str, m: str) -> Column:
        """The size of the largest set that one of size ``n`` can be so similar to with ``m`` common shingles."""
        return F.col(m) * ((1 + self.similarity) / self.similarity) - F.col(n) + 1e-6

    def _early(self, members: DataFrame) -> DataFrame:
        """(gram, node, component, n, m) of the nodes of ``members``: their shingles that stand early enough to meet a similar set; m: shingles from there on."""
        nodes = stored(members.select("node", "component").distinct(), "nodes")
        held = stored(_held(self.sets.join(nodes, "node")), "held")
        spread = held.groupBy("gram").agg(F.count("*").alias("holders"), (F.min("component") < F.max("component")).alias("met"))
        one = Window.partitionBy("node")
        before = F.row_number().over(one.orderBy("met", "holders", "gram")) - 1
        placed = held.join(spread, "gram").withColumn("n", F.count("*").over(one)).withColumn("m", F.col("n") - before)
        early = F.col("met") & (self.similarity * F.col("n") <= self._most("n", "m"))
        placed = stored(placed.where(early).select("gram", "node", "component", "n", "m"), "placed")
        drop_stored(held, nodes)
        return placed

    def finish(self) -> None:
        """Compare what is left in open keys exactly, nodes of the smallest components first."""
        named = self._named()
        members = self._early(named.join(self._open(named), "band")).withColumnRenamed("gram", "band")
        members = members.join(self._open(members), "band")
        in_order = Window.partitionBy("band").orderBy("size", "component")
        ranks = members.groupBy("band", "component").agg(F.count("*").alias("size"))
        # One row for each component of an open shingle.
        ranks = stored(ranks.select("band", "component", F.row_number().over(in_order).alias("rank")), "ranks")
        last = ranks.agg(F.max("rank")).first()[0] or 0
        members = stored(members.join(ranks, ["band", "component"]).select("band", "node", "rank", "n", "m"), "members")
        done, step = 0, 1
        while done < last - 1:
            first = members.where((F.col("rank") > done) & (F.col("rank") <= done + step))
            a, b = (x.select(*[F.col(c).alias(f"{side}_{c}") for c in x.columns]) for side, x in (("a", first), ("b", members)))
            fit = (F.col("b_rank") > F.col("a_rank")) & (F.col("b_n") <= self._most("a_n", "a_m")) & (F.col("a_n") <= self._most("b_n", "b_m"))
            pairs = a.join(b, (F.col("a_band") == F.col("b_band")) & fit).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
            for side in "ab":
                now = self.groups.select(F.col("node").alias(side), F.col("component").alias(f"{side}c"))
                pairs = pairs.join(now, side, "left").withColumn(f"{side}c", F.coalesce(f"{side}c", side))
            self.compare(pairs.where("ac <> bc").select("a", "b"))
            done, step = done + step, step * 16


def near_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row per row of ``docs``: (id_col, component_id, text_hash, first), components of pairs at least ``similarity`` alike.

    ``first`` marks the rows with the smallest id, and of these the smallest hash of the text, of their component.

    * Null, empty and blank texts are equal. Case is that of ASCII letters only.
    * A row with a null id has the component_id of the documents with its set of shingles, or null if none of them has an
      id. Null ids are never a component_id.
    * Repeated rows give repeated rows; documents of one id are told apart by their texts. An empty table gives no rows.
      Other columns are not read.
    * Texts of any length are read whole; a text and its shingles must fit into a task. Of equally good leaders the one
      with the lower hash is asked, which decides in which round links are found but not which.
    """
    if not SIMILARITY <= similarity <= 1:
        raise ValueError(f"the keys reach similarities from {SIMILARITY}")
    marks = stored(sketches(docs, words_per_shingle, id_col=id_col, text_col=text_col), "sketches")
    nodes = marks.where("id is not null").groupBy("node").agg(
        F.min(F.struct("id", "text_hash")).alias("rep"), *[F.first(c).alias(c) for c in ("n", "fp", "bands")]
    )
    linked = stored(simhash_links(nodes), "linked")
    keys = nodes.select("node", F.explode("bands").alias("band"))
    sizes = keys.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(keys.join(sizes, "band"), "shared")
    # How many nodes a node shares keys with, each as often as it does.
    weighed = shared.join(shared.groupBy("node").agg(F.sum("size").alias("weight")), "node")
    leaders = weighed.groupBy("band").agg(F.min(F.struct(-F.col("weight"), "node")).alias("lead"))
    leads = stored(shared.join(leaders, "band").groupBy("node").agg(F.min("lead")["node"].alias("lead")), "leads")
    ends = leads.select("node").unionByName(linked.select(F.col("a").alias("node"))).unionByName(linked.select(F.col("b").alias("node")))
    asked = stored(nodes.select("node", "n", "rep").join(ends.distinct(), "node"), "asked")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(asked.select(F.col("rep.id").alias("id")), "id", "left_semi")
    sets = stored(_sets(texts, words_per_shingle).dropDuplicates(["node"]), "sets")
    search = _Search(asked, shared, sets, similarity)
    search.compare(linked.unionByName(leads.where("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b"))))
    for turn in range(LEADER_ROUNDS):
        search.ask_leaders(turn)
    search.finish()
    groups = search.groups
    named = nodes.select("node", "rep").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("rep"))
    named = named.select("node", "component").join(least, "component").select("node", "rep")
    first = F.coalesce((F.col("id") == F.col("rep.id")) & F.col("text_hash").eqNullSafe(F.col("rep.text_hash")), F.lit(False))
    found = marks.select("id", "text_hash", "node").join(named, "node", "left")
    return found.select(F.col("id").alias(id_col), F.col("rep.id").alias("component_id"), "text_hash", first.alias("first"))
