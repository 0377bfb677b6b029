"""Line dedup by pairwise alignment.

Lines found in one document only say nothing and are dropped at once: what remains of a document is the rare row of its
shared lines with their positions. Its shortest runs of ``MIN_WORDS`` words, from every line on and up to every line, are
hashed, and the document is paired with the first one (by id) that holds each run. Pairs grow with the occurrences of shared
runs and not with the square of how often one occurs, so no frequency is too high to be followed; and any block that an
earlier document has is made of such runs. Each pair is aligned by patience diff; where that matches no further (lines
that recur, blocks in another order) equal runs are matched one by one, so one earlier block covers any number of later
copies. Common blocks of ``MIN_WORDS`` words or more are deleted from the later document. A deleted line lives on in an
earlier document: the first one that has the block never loses it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import python_batches, stored
from barloom.llm.quality import SPACE, bound

MIN_WORDS = 50
#: Order of documents without an id.
LAST = (1 << 63) - 1


def key(id_col: str, text_col: str) -> Column:
    """What tells documents apart, and orders them: the id (null last), then a hash of the text."""
    return F.struct(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("id"), F.xxhash64(text_col).alias("text"))


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, hashes, words): hash and number of words of each line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in python_batches(batches):
            hashes, words = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                lines = [x for x in (line.strip() for line in (text or b"").split(b"\n")) if x]
                hashes.append(np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64).view(np.int64))
                words.append([len(x.split()) for x in lines])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))], ["key", "hashes", "words"]
            )

    picked = docs.select(key(id_col, text_col).alias("key"), F.col(text_col))
    return picked.mapInArrow(run, "key struct<id: bigint, text: bigint>, hashes array<bigint>, words array<int>")


def longest_rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b) of two rows of line hashes, rising in both.

    Common heads and tails match; between them lines that occur once in both rows, in their longest common order, split
    the rows, and so on in between. Where no line is unique the rows are matched no further.
    """
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b[x] == 1}
        both = [(where[x], j) for j, x in enumerate(b[b0:b1], b0) if x in where]
        anchors = [both[i] for i in longest_rising([i for i, _ in both])]
        last = (a0, b0)
        for i, j in anchors:
            matched.append((i, j))
            todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        if anchors:
            todo.append((last[0], a1, last[1], b1))
    return sorted(matched)


def shortest_runs(row: list[tuple], min_words: int) -> list[tuple[int, int]]:
    """[start, end) of the shortest runs of lines that follow each other and have ``min_words`` words, from and up to each line.

    ``row`` is a row of (position, hash, words).
    """
    found = set()
    for step in (1, -1):
        line = row[::step]
        end, size = 0, 0
        for start in range(len(line)):
            while size < min_words and end < len(line) and (end == start or line[end][0] - line[end - 1][0] == step):
                size += line[end][2]
                end += 1
            if size >= min_words:
                found.add((start, end) if step > 0 else (len(line) - end, len(line) - start))
            size -= line[start][2]
    return sorted(found)


def run_hash(row: list[tuple], start: int, end: int) -> int:
    return xxhash.xxh64_intdigest(b"".join(x[1].to_bytes(8, "little", signed=True) for x in row[start:end])) - (1 << 63)


def recurring(a: list[tuple], b: list[tuple], min_words: int) -> list[int]:
    """Positions in ``b`` of runs of ``min_words`` words that ``a`` has anywhere."""
    known = {run_hash(a, *run) for run in shortest_runs(a, min_words)}
    return [b[k][0] for start, end in shortest_runs(b, min_words) if run_hash(b, start, end) in known for k in range(start, end)]


def common_blocks(a: list[tuple], b: list[tuple], min_words: int) -> list[int]:
    """Positions in ``b`` of blocks of ``min_words`` words that patience diff aligns; a and b are (position, hash, words) rows."""
    out: list[int] = []
    block: list[int] = []
    size, last = 0, None
    for i, j in [*patience([x[1] for x in a], [x[1] for x in b]), (-1, -1)]:
        follows = i >= 0 and last is not None and a[i][0] == last[0] + 1 and b[j][0] == last[1] + 1
        if not follows:
            if size >= min_words:
                out += block
            block, size = [], 0
        if i >= 0:
            block.append(b[j][0])
            size += b[j][2]
            last = (a[i][0], b[j][0])
    return out


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, lines): positions (among lines with a word) of the lines to delete, for documents that have any."""
    rows = stored(line_rows(docs, id_col, text_col), "lines")
    each = rows.select("key", F.explode(F.array_distinct("hashes")).alias("h"))
    held = each.groupBy("h").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last").select("h")
    spread = rows.select("key", F.posexplode(F.arrays_zip("hashes", "words")).alias("at", "x"))
    shared = spread.select("key", "at", F.col("x.hashes").alias("h"), F.col("x.words").alias("w")).join(held, "h")
    shared = stored(shared.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", "h", "w"))).alias("row")), "shared-lines")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in python_batches(batches):
            found = []
            for row in batch.column(1).to_pylist():
                row = [(x["at"], x["h"], x["w"]) for x in row]
                found.append(list({run_hash(row, *run) for run in shortest_runs(row, min_words)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["key", "runs"])

    runs = shared.mapInArrow(cut, "key struct<id: bigint, text: bigint>, runs array<bigint>").select("key", F.explode("runs").alias("run"))
    runs = stored(runs, "runs")
    first = runs.groupBy("run").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last").select("run", "first")
    pairs = runs.join(first, "run").where("key <> first").select("key", "first").distinct()
    met = pairs.join(shared, "key").join(shared.select(F.col("key").alias("first"), F.col("row").alias("earlier")), "first").select("key", "row", "earlier")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in python_batches(batches):
            found = []
            for later, earlier in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a, b = ([(x["at"], x["h"], x["w"]) for x in row] for row in (earlier, later))
                cut = set(common_blocks(a, b, min_words))
                found.append(sorted(cut.union(recurring(a, b, min_words))))
            some = pa.array([bool(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["key", "lines"]).filter(some)

    deleted = met.mapInArrow(align, "key struct<id: bigint, text: bigint>, lines array<int>")
    return deleted.select("key", F.explode("lines").alias("at")).groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("lines"))


def _without(text: Column, cut: Column) -> Column:
    """``text`` without the lines whose position among the lines with a word is in ``cut``."""
    def drop(lines: Column) -> Column:
        worded = F.filter(
            F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(SPACE)) != "", i)), lambda i: i.isNotNull()
        )  # place of each line with a word
        return bound(
            worded,
            lambda places: bound(
                F.transform(cut, lambda k: F.get(places, k)),
                lambda out: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out), lambda i: F.get(lines, i)), "\n"),
            ),
        )

    return bound(F.split(text, "\n"), drop)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with shortened texts and a column ``deleted_lines`` (in place of one of that name); lines keep their order.

    * Lines compare without white space around them; blank lines are never common and never deleted.
    * Null, empty and blank texts stay as they are. A text that loses all lines becomes empty or blank, not null.
    * Repeated rows (equal id and text) are one document and get equal results. Documents with equal ids are ordered by a
      hash of their texts; a null id is later than all others. An empty table gives no rows.
    * Texts of any length are read whole: tasks hold the lines of a batch of documents, and the shared lines of a pair.
    """
    cut = repeated_lines(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    # The row goes along as one column, so that no name can clash.
    marked = docs.select(F.struct(*docs.columns).alias("row"), key(id_col, text_col).alias("key"))
    marked = marked.join(cut.select("key", F.col("lines").alias("cut")), "key", "left")
    text = F.col("row")[text_col]
    shorter = F.when(F.col("cut").isNull(), text).otherwise(_without(text, F.col("cut")))
    count = F.coalesce(F.size("cut"), F.lit(0)).cast("bigint")
    kept = [shorter.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != "deleted_lines"]
    return marked.select(*kept, count.alias("deleted_lines"))
