"""Packing against a plain packing of every single piece, and against the tokenizer's own ids."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import packing
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def plain_packing(sizes, capacity):
    """Sequences of sizes, one piece at a time."""
    left, out = sorted(sizes, reverse=True), []
    while left:
        held, gap = [], capacity
        while True:
            fits = next((i for i, s in enumerate(left) if s <= gap), None)
            if fits is None:
                break
            gap -= left[fits]
            held.append(left.pop(fits))
        if gap and left:
            small = min(held)
            best = small, 0, 0
            for i in range(len(left)):
                for j in range(i):
                    both = left[i] + left[j]
                    if both <= gap + small and (both, -min(left[i], left[j])) > (best[0], -best[1] if best[1] else 0) and both > small:
                        best = both, min(left[i], left[j]), max(left[i], left[j])
            if best[1]:
                held.remove(small)
                for s in best[1:]:
                    left.remove(s)
                    held.append(s)
                left = sorted([*left, small], reverse=True)
        out.append(sorted(held))
    return sorted(out)


def test_plan_against_single_pieces():
    rng = random.Random(3)
    for capacity in (7, 16, 30):
        for _ in range(60):
            sizes = [rng.choice([rng.randint(1, capacity), rng.randint(1, 4)]) for _ in range(rng.randint(0, 60))]
            runs = packing.plan(Counter(sizes), capacity)
            got = sorted(sorted(Counter(pieces).elements()) for times, pieces in runs for _ in range(times))
            assert got == plain_packing(sizes, capacity)


def test_plan_is_tight_and_short():
    rng = np.random.default_rng(4)
    sizes = np.clip(rng.lognormal(5.5, 1, 200_000).astype(int), 1, 1024)
    runs = packing.plan(Counter(sizes.tolist()))
    assert sum(times for times, _ in runs) <= 1.002 * sizes.sum() / 1024 + 1
    assert len(runs) < 5000
    used = Counter()
    for times, pieces in runs:
        assert sum(s * n for s, n in pieces.items()) <= 1024
        used.update({s: times * n for s, n in pieces.items()})
    assert used == Counter(sizes.tolist())


@pytest.mark.parametrize("total,want", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (24, [(0, 8), (8, 8), (16, 8)])])
def test_cut(total, want):
    assert packing.cut(total, 8) == want


def check_sequences(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_query_against_the_tokenizer(spark):
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_best_fit_packing"](spark, SF).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    sizes = []
    for doc_id, text in docs.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 1024 or (k == 0 and r.length == (len(ids) % 1024 or 1024))
            at += r.length
            sizes.append(r.length)
        assert at == len(ids)
    n = check_sequences(got, 1024)
    assert n == sum(times for times, _ in packing.plan(Counter(sizes)))
    assert n <= 1.02 * sum(sizes) / 1024 + 1


def test_defined_cases(spark):
    long = "long words go on " * 9000
    rows = [(1, None, 7), (1, "", 7), (None, "a word", 7), (2, long, 7), (3, "same", 7), (3, "same", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    found = packing.pack_documents(docs, TOKENIZER, with_ids=True)
    got = found.collect()
    check_sequences(got, 1024)
    assert sorted(r.length for r in got if r.doc_id == 1) == [1, 1] and all(r.ids == [2] for r in got if r.doc_id == 1)
    assert len([r for r in got if r.doc_id == 3]) == 2 and len([r for r in got if r.doc_id is None]) == 1
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    t = Tokenizer.from_file(TOKENIZER)
    whole = [i for r in sorted((r for r in got if r.doc_id == 2), key=lambda r: r.piece) for i in r.ids]
    assert t.decode(whole[:-1], skip_special_tokens=False) == long and whole[-1] == 2
    packed = packing.sequences(found).collect()
    assert sum(len(r.ids) for r in packed) == sum(r.length for r in got)
    assert all([p.length for p in r.pieces] == [x.length for x in sorted((g for g in got if g.sequence_id == r.sequence_id), key=lambda g: g.offset)] for r in packed)
    assert packing.pack_documents(docs.limit(0), TOKENIZER).collect() == []
