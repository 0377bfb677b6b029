"""Spelling variants by one-edit neighbourhoods over a reduced alphabet.

1. Words. Tasks count the runs of letters of whole texts and combine their counts before the shuffle.
2. Reduction. Letters are mapped to a few symbols, dealt so that each stands for about as many letters of the vocabulary.
   There are as many symbols as spread the shortest words (``MIN_LETTERS`` letters) over the vocabulary's size, so that a
   reduced word stands for a few words on average at any size. A reduced word is a number: a polynomial of its symbols.
3. Neighbourhoods. Words that are one edit apart have reduced words that are equal or one edit apart. Every reduced word
   generates its one-edit neighbourhood. Neighbourhoods are symmetric, so each pair is asked for from one end: deletions by
   the longer word (they are the shorter one's insertions), replacements by the larger number.
4. Verification. Neighbours in the reduced vocabulary, found by an equi-join, are compared on the words themselves.

The map of letters and the symbols only decide which pairs are looked at, never which are near.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import drop_stored, python_batches, stored

MIN_LETTERS = 6
MIN_COUNT = 5
#: A word's form is at least so many times as frequent.
RATIO = 5
#: Reduced words are polynomials at this odd number, modulo 2^64.
POINT = 0x9E3779B97F4A7C15
#: Words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: One byte for each letter of A-Z (lower-cased), a-z and U+00C0 to U+00FF, a blank for all other code points.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 0xC0 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def runs(text: str | None) -> list[bytes]:
    """The runs of letters of a text in Latin-1; A-Z lower-cased."""
    return (text or "").encode("latin-1", "replace").translate(LETTERS).split()


def document_words(doc_id: int | None, text: str | None, min_letters: int, misspelt: int | None) -> Counter[bytes]:
    """The words of a document with at least ``min_letters`` letters, in Latin-1.

    With ``misspelt`` a run of letters loses one of them in each document where that number divides the hash of both.
    """
    found = Counter(w for w in runs(text) if len(w) >= min_letters)
    if not misspelt:
        return found
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    hashes = np.fromiter((zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed) for w in found), np.int64, len(found))
    hit = np.flatnonzero(hashes % misspelt == 0)
    if len(hit):
        each = list(found)
        lost = [(each[i], int(hashes[i])) for i in hit]
        shorter = [(w[: h % len(w)] + w[h % len(w) + 1 :], found.pop(w)) for w, h in lost]
        for w, n in shorter:
            if len(w) >= min_letters:
                found[w] += n
    return found


def vocabulary(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, misspelt: int | None = None
) -> DataFrame:
    """(word, n): the words of all texts and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"]
            )

        for batch in python_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update(document_words(doc_id, text, min_letters, misspelt))
                if len(found) > HELD_WORDS:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    counted = docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def symbols(words: DataFrame, count: int) -> np.ndarray:
    """The symbol of each Latin-1 letter: letters by frequency, each to the symbol that stands for fewest so far."""
    # One row for each letter.
    seen = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    load = [0] * count
    table = np.zeros(256, np.int64)
    for row in sorted(seen, key=lambda r: (-r["count"], r["letter"])):
        if row["letter"]:
            table[ord(row["letter"])] = least = load.index(min(load))
            load[least] += row["count"]
    return table


def symbol_count(n_words: int, letters: int = MIN_LETTERS) -> int:
    return max(4, math.ceil(n_words ** (1 / letters)))


def reduced_numbers(digits: np.ndarray) -> np.ndarray:
    """The numbers of equally long rows of symbols."""
    number = np.zeros(len(digits), np.uint64)
    for column in digits.T:
        number = number * np.uint64(POINT) + column.astype(np.uint64)
    return number


def neighbourhood(digits: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the (deletions, replacements) of equally long rows of symbols below ``count``."""
    n, length = digits.shape
    digits = digits.astype(np.uint64)
    power = np.array([pow(POINT, length - 1 - i, 1 << 64) for i in range(length)], np.uint64)
    number = (digits * power).sum(axis=1, dtype=np.uint64)
    # Without place i the symbols before it move down one place.
    shorter = np.array([pow(POINT, max(length - 2 - i, 0), 1 << 64) for i in range(length)], np.uint64)
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(digits * shorter, axis=1, dtype=np.uint64)[:, :-1]], axis=1)
    after = (digits * power)[:, ::-1].cumsum(axis=1, dtype=np.uint64)[:, ::-1] - digits * power
    others = (digits[:, :, None] + np.arange(1, count, dtype=np.uint64)) % np.uint64(count)
    changed = number[:, None, None] + (others - digits[:, :, None]) * power[None, :, None]
    return before + after, changed.reshape(n, -1)


def reduced(words: DataFrame, table: np.ndarray) -> DataFrame:
    """(word, n, size, number, symbols): length, number and symbols of each reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = table.astype(np.uint8)
        for batch in batches:
            each = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            size = np.array([len(w) for w in each], np.int64)
            number = np.zeros(len(each), np.uint64)
            for length in np.unique(size):
                own = np.flatnonzero(size == length)
                letters = np.frombuffer(b"".join(each[i] for i in own), np.uint8).reshape(len(own), length)
                number[own] = reduced_numbers(table[letters])
            digits = [w.translate(low.tobytes()) for w in each]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(size), pa.array(number.view(np.int64)), pa.array(digits, pa.binary())],
                ["word", "n", "size", "number", "symbols"],
            )

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, size bigint, number bigint, symbols binary")


def neighbours(different: DataFrame, count: int) -> DataFrame:
    """(size, number, to_size, to_number): itself and its neighbourhood, each number once, for each reduced word of (symbols)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in python_batches(batches, 4096):
            each = batch.column(0).to_pylist()
            sizes = np.array([len(w) for w in each])
            for length in np.unique(sizes):
                own = [w for w, size in zip(each, sizes) if size == length]
                digits = np.frombuffer(b"".join(own), np.uint8).reshape(len(own), length)
                number = reduced_numbers(digits)
                shorter, changed = neighbourhood(digits, count)
                for to_size, found in ((length - 1, shorter), (length, np.concatenate([changed, number[:, None]], axis=1))):
                    found = np.sort(found, axis=1)
                    new = np.ones(found.shape, bool)
                    new[:, 1:] = found[:, 1:] != found[:, :-1]
                    if to_size == length:
                        new &= found <= number[:, None]
                    row, _ = np.nonzero(new)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(row), length, np.int64)), pa.array(number[row].view(np.int64)),
                            pa.array(np.full(len(row), to_size, np.int64)), pa.array(found[new].view(np.int64)),
                        ],
                        ["size", "number", "to_size", "to_number"],
                    )

    return different.select("symbols").mapInArrow(run, "size bigint, number bigint, to_size bigint, to_number bigint")


def near_words(words: DataFrame, *, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n, near, near_n), both ways: the pairs of ``words`` (word, n) that are one edit apart."""
    count = symbol_count(words.count(), min_letters)
    own = stored(reduced(words, symbols(words, count)), "reduced")
    asked = neighbours(own.select("symbols").distinct(), count)
    keys = own.select(F.col("size").alias("to_size"), F.col("number").alias("to_number")).distinct()
    # Different reduced words may have one number: their pairs count once.
    pairs = asked.join(keys, ["to_size", "to_number"], "left_semi").distinct()
    left = own.select("size", "number", F.col("word").alias("a"), F.col("n").alias("an"))
    right = own.select(F.col("size").alias("to_size"), F.col("number").alias("to_number"), F.col("word").alias("b"), F.col("n").alias("bn"))
    met = pairs.join(left, ["size", "number"]).join(right, ["to_size", "to_number"])
    # Equal reduced words meet themselves: each two words once.
    once = (F.col("size") != F.col("to_size")) | (F.col("number") != F.col("to_number")) | (F.col("a") < F.col("b"))
    near = met.where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "an", "b", "bn")
    near = stored(near, "near-words")
    drop_stored(own)
    return near.select(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("near"), F.col("bn").alias("near_n")).unionByName(
        near.select(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("near"), F.col("an").alias("near_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form; steps double each round, and each step is to a more frequent word."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_stored(at)
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    misspelt: int | None = None,
) -> DataFrame:
    """One row per word: (word, form, root, n, n_near, form_n).

    * Null and empty texts have no words; a null id counts as an empty one. Texts of any length are read whole.
    * Of near words that are equally frequent the smallest in code-point order is the form. Repeated rows count again.
    * An empty table gives no rows. Other columns are not read.
    """
    if min_letters < 2 or ratio < 2:
        raise ValueError("words have two letters or more, and forms are at least twice as frequent")
    words = stored(
        vocabulary(docs, id_col=id_col, text_col=text_col, min_letters=min_letters, min_count=min_count, misspelt=misspelt), "vocabulary"
    )
    best = near_words(words, min_letters=min_letters).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    )
    enough = -F.col("best.order") >= ratio * F.col("n")
    told = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.order")).alias("form_n"),
    )
    told = stored(told, "forms")
    last = roots(told.where("form is not null"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
