"""The trie of conversation prefixes against one that is built turn by turn."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import tries
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(rows, family=None):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in convs.items()}
    built = convs
    if family:
        built = {}
        for c, turns in convs.items():
            h = zlib.crc32(str(c).encode()) % 4
            built[c] = convs.get(c - (abs(c) % family) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = {p: 0 for p in nodes}, {p: 0 for p in nodes}
    for p, members in nodes.items():
        gain = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += children[p] == 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(p)))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def answer(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_query_against_a_plain_trie(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_trie"](spark, SF)
    assert answer(got) == plain_trie(rows, 20)


def made_up(rng, n):
    texts = ["a b", "", "c", "longer turn of words", None]
    rows = []
    for c in range(n):
        c = rng.choice([c, -c, c * 20])
        rows += [(c, rng.choice([None, t, t, t]), rng.choice(["user", None]), rng.choice(texts)) for t in range(rng.randrange(5))]
    return list(dict.fromkeys(rows))


@pytest.mark.parametrize("family", [None, 20])
def test_tours_of_made_up_conversations(spark, monkeypatch, family):
    """Small groups, so that coins are tossed in many rounds and running values need several levels."""
    monkeypatch.setattr(tries, "LAST", 8)
    monkeypatch.setattr(tries, "GROUP", 32)
    monkeypatch.setattr(tries, "BLOCK", 3)
    monkeypatch.setattr(tries, "STRETCH", 2)
    monkeypatch.setattr(tries, "PIECE", 2)
    rng = random.Random(6)
    rows = made_up(rng, 60) + [(1000, t, "user", f"turn {t % 7}") for t in range(100)] + [(c, 0, "system", "hot") for c in range(2000, 2040)]
    found = tries.prefix_trie(conversations(spark, rows).repartition(5), family=family)
    assert answer(found) == plain_trie(rows, family)
    tour = sorted(x for r in found.select("enter", "leave").collect() for x in r)
    assert tour == list(range(len(tour)))


def test_ranks_of_lists():
    rng = np.random.default_rng(7)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        order, cuts = rng.permutation(n), rng.random(n) < 0.2
        after = np.full(n, -1)
        for a, b, cut in zip(order, order[1:], cuts):
            after[a] = -1 if cut else b
        sums = rng.integers(0, 9, (n, 2))
        head, last, before = tries._ranks(after, sums)
        start = None
        for i, a in enumerate(order):
            if start is None:
                start, total = a, np.zeros(2, int)
            assert head[a] == start and (before[a] == total).all()
            total = total + sums[a]
            if after[a] < 0:
                assert last[start] == a
                start = None


def test_defined_cases(spark):
    rows = [(None, 0, "user", "x"), (5, 0, None, None), (5, 0, None, None), (7, None, "user", "b"), (7, None, "user", "a"), (7, 1, "user", "c")]
    df = conversations(spark, rows).withColumn("words", F.lit("clash")).withColumn("node", F.lit(1))
    assert answer(tries.prefix_trie(df)) == plain_trie(rows)
    assert tries.prefix_trie(df.limit(0)).collect() == []
    assert tries.prefix_trie(df.where("conv_id is null")).collect() == []
    long = [(1, 0, "user", "word " * 300_000), (2, 0, "user", "word " * 300_000)]
    assert answer(tries.prefix_trie(conversations(spark, long))) == plain_trie(long)
