"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

1. Pieces. A document is its ids and an end id; only one that is longer than a sequence is cut, into whole sequences
   behind a first piece that takes what is left over. Each task numbers its pieces of equal length.
2. Plan. What a packing needs to know of the pieces is how many there are of each length: as many counts as a sequence has
   tokens, whatever the corpus. A sequence is filled greedily, the longest piece that fits each time; then its smallest
   piece gives way to the two unpacked pieces that fill the gap it leaves most tightly, if they fill it better. The choice
   only depends on which lengths are left, so a pattern is repeated for as long as its lengths last and the plan has a few
   runs of equal sequences for each length at most.
3. Places. A piece's number among all of its length (its number in its task and the counts of earlier tasks) names its
   sequence and its offset.

Nothing but the counts leaves the tasks, and no task sees more than its own pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.bitplanes import Encoder
from barloom.llm.common import python_batches, stored

CAPACITY = 1024
END_ID = 2
#: Characters whose texts are encoded together.
HELD_CHARACTERS = 1 << 22


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes the rest of a division into whole sequences."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def _fill(left: list[int], capacity: int) -> tuple[dict[int, int], dict[int, int]]:
    """(pieces of the sequence by length, pieces that must be left for the same choice) with ``left`` pieces of each length."""
    greedy: Counter[int] = Counter()
    gap = size = capacity
    while gap:
        size = min(size, gap)
        while size and left[size] == greedy[size]:
            size -= 1
        if not size:
            break
        n = min(left[size] - greedy[size], gap // size)
        greedy[size] += n
        gap -= n * size
    need = dict(+greedy)
    if not gap:
        return need, need
    small = min(need)
    room = gap + small
    free = [left[s] - greedy[s] for s in range(room + 1)]
    best, pair = small, None
    long = room - 1
    for short in range(1, room // 2 + 1):
        if not free[short]:
            continue
        long = min(long, room - short)
        while long >= short and free[long] < 1 + (long == short):
            long -= 1
        if long < short:
            break
        if short + long > best:
            best, pair = short + long, (short, long)
        if best == room:
            break
    if pair is None:
        return need, need
    final = greedy.copy()
    final[small] -= 1
    final.update(pair)
    final = +final
    return dict(final), {s: max(greedy[s], final[s]) for s in {*greedy, *final}}


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(sequences, pieces by length) runs of equal sequences that use up ``counts`` pieces of each length."""
    left = [counts.get(s, 0) for s in range(capacity + 1)]
    runs = []
    while any(left):
        final, need = _fill(left, capacity)
        times = min((left[s] - need[s]) // final[s] + 1 for s in final)
        for s, n in final.items():
            left[s] -= times * n
        runs.append((times, final))
    return runs


def places(runs: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each stretch of pieces of equal length and equal sequences, in the order of (length, first): ``length``, number of
    the first piece, first sequence, pieces in a sequence and offset of the first of them."""
    rows, used, sequence = [], defaultdict(int), 0
    for times, pieces in runs:
        offset = 0
        for size in sorted(pieces, reverse=True):
            rows.append((size, used[size], sequence, pieces[size], offset))
            used[size] += times * pieces[size]
            offset += size * pieces[size]
        sequence += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "sequence", "each", "offset"), columns))


def pieces(
    docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, task, number[, ids]): ``number`` counts the pieces of equal length of a task."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = Encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)

        def rows(held: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            for (doc_id, _), raw in zip(held, encoder.encode([t for _, t in held])):
                raw += end
                for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    part = raw[4 * start : 4 * (start + length)]
                    out.append((doc_id, k, start, length, zlib.crc32(part), task, seen[length], part))
                    seen[length] += 1
            ids, *others, parts = zip(*out)
            arrays = [pa.array(ids, pa.int64()), pa.array(others[0], pa.int32()), *(pa.array(x, pa.int64()) for x in others[1:])]
            if with_ids:
                ends = np.cumsum([0, *map(len, parts)]) // 4
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, names)

        held, size = [], 0
        for batch in python_batches(batches):
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(row)
                size += len(row[1] or "")
                if size >= HELD_CHARACTERS:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    names = [id_col, "piece", "start", "length", "ids_crc32", "task", "number"] + ["ids"] * with_ids
    schema = f"`{id_col}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, number bigint"
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: (id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    * A null or empty text is its end id alone. Rows with a null id are packed like others; repeated rows and ids are
      documents of their own. An empty table gives no rows. Other columns are not read.
    * A text of any length is encoded whole; its ids must fit into the memory of one task.
    * Pieces of equal length take their places in the order in which tasks meet them; of pairs that fill a gap equally
      well the one with the shortest piece is taken.
    """
    found = stored(
        pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces"
    )
    # One row for each length of each task; the window has one row for each task.
    counts = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.select("length", "task", "n", F.coalesce(before, F.lit(0)).alias("before")), "piece-counts")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    where = docs.sparkSession.sparkContext.broadcast(places(plan({r["length"]: r["n"] for r in totals}, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = where.value
        # Lengths are small numbers, and so are numbers of pieces next to 2^50.
        starts = (at["length"] << 50) + at["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(starts, (length << 50) + rank, "right") - 1
            turn = rank - at["first"][k]
            sequence = at["sequence"][k] + turn // at["each"][k]
            offset = at["offset"][k] + turn % at["each"][k] * length
            columns = dict(zip(batch.schema.names, batch.columns)) | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in out], out)

    out = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    ranked = found.join(counts.drop("n"), ["length", "task"]).withColumn("rank", F.col("number") + F.col("before"))
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", "rank", *["ids"] * with_ids)
    schema = f"`{id_col}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def sequences(packed: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, pieces) of ``pack_documents(with_ids=True)``: ids side by side, and (id_col, piece, length) of each part.

    A sequence holds no more than its capacity, so a group is small however many documents there are.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(id_col), "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.transform("parts", lambda p: F.struct(p[id_col].alias(id_col), p["piece"].alias("piece"), p["length"].alias("length"))).alias("pieces"),
    )
