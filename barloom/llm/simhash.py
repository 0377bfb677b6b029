"""Near duplicates by SimHash fingerprints, compared around the anchors of a covering code.

The anchors are the codewords of the binary Hamming code of length 63, a perfect code: every point of the first
63 bits lies within distance 1 (the covering radius) of exactly one anchor. Of two fingerprints at distance 2 or
less, a point midway lies within 1 of both and within 1 of its anchor; so both lie within covering radius plus half
the threshold, that is 2, of that anchor. Each fingerprint is therefore replicated to all anchors within 2 of it: 1 if
it is an anchor itself, else 32. (Replicating one side only needs covering radius plus the whole threshold, 3, and some
650 copies for the same pairs.) Nothing is missed, and a group around an anchor holds fingerprints within 2 of one
point only: 4,034 different ones at most, whatever the table size. Equal fingerprints are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import components, python_batches, stored

BLOCK = 1 << 16
THRESHOLD = 2


def fingerprint(text: bytes | None, *, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a UTF-8 text; 0 where there is no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    n = len(words) - k + 1
    hashed = map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, zip(*(words[i:] for i in range(k)))))
    return majority((np.fromiter(hashed, np.uint64, min(BLOCK, n - at)) for at in range(0, n, BLOCK)), n)


def majority(blocks: Iterable[np.ndarray], n: int) -> int:
    """The bits set in over half of ``n`` unsigned 64-bit hashes that come in blocks; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for block in blocks:
        ones += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a BIGINT. A null text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in python_batches(batches):
            fps = np.array([fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, fp bigint")


def _point(i: Column) -> Column:
    """The bit that stands at position i of the code (1 to 63); none at 0."""
    return F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), i - 1))


def anchors(fp: Column) -> Column:
    """All codewords within distance 2 of the first 63 bits of ``fp``."""
    masks = [sum(1 << (i - 1) for i in range(1, 64) if i >> k & 1) for k in range(6)]
    syndrome = sum(
        (F.bit_count(fp.bitwiseAND(F.lit(m))) % 2) * (1 << k) for k, m in enumerate(masks)
    )  # positions of the set bits, xor-ed: 0 for a codeword, else the one bit to flip
    low = fp.bitwiseAND(F.lit((1 << 63) - 1))

    def around(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i < i.bitwiseXOR(s))
        flipped = F.transform(first, lambda i: low.bitwiseXOR(_point(i)).bitwiseXOR(_point(i.bitwiseXOR(s))))
        return F.when(s == 0, F.array(low)).otherwise(flipped)

    return F.get(F.transform(F.array(syndrome.cast("int")), around), F.lit(0))


def _tree(fps: np.ndarray, ids: np.ndarray, threshold: int) -> tuple[list[int], list[int]]:
    """For each local group the links from its members to the smallest id in it."""
    order = np.argsort(ids)
    fps, ids = fps[order], ids[order]
    free = np.ones(len(ids), bool)
    a, b = [], []
    for root in range(len(ids)):
        if not free[root]:
            continue
        free[root], reach = False, [root]
        while reach:
            at = reach.pop()
            near = np.flatnonzero(free & (np.bitwise_count(fps ^ fps[at]) <= threshold))
            free[near] = False
            reach.extend(near.tolist())
            a.extend([int(ids[root])] * len(near))
            b.extend(ids[near].tolist())
    return a, b


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links that join all (fp, rep) rows whose fingerprints differ in at most ``threshold`` bits (2 or less)."""
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors cover thresholds up to 2")
    groups = (
        distinct.select("fp", "rep", F.explode(anchors(F.col("fp"))).alias("anchor"))
        .groupBy("anchor")
        .agg(F.collect_list(F.struct("fp", "rep")).alias("near"))
        .where(F.size("near") > 1)
        .select(F.col("near.fp").alias("fps"), F.col("near.rep").alias("reps"))
    )

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            a, b = [], []
            for fps, reps in zip(frame["fps"], frame["reps"]):
                more = _tree(np.asarray(fps, np.int64), np.asarray(reps, np.int64), threshold)
                a += more[0]
                b += more[1]
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return groups.mapInPandas(compare, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: (id_col, fingerprint, component_id).

    * Null, empty and blank texts have fingerprint zero and are linked like any other.
    * A row with a null id keeps its fingerprint; its component_id is that of the documents with that fingerprint, or
      null if none of them has an id. Null ids are never a component_id.
    * Repeated rows and ids give repeated rows. An empty table gives no rows. Other columns are not read.
    * Texts of any length are read whole, their shingles in blocks.
    """
    fps = stored(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    groups = components(links(distinct.where("rep is not null"), threshold))
    merged = distinct.join(groups, distinct["rep"] == groups["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(merged, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
