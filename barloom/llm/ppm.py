"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of the bytes that followed. A byte is
coded in the longest context of the tree that the language has seen; if the language never saw the byte there, an escape
is coded (method C: as likely as the number of different bytes seen there) and the next shorter context is tried, down
to equal shares. Counts are frozen after training, so the code length of every (context, byte) is one table entry and a
text costs one lookup a byte for all languages at once. The language with the shortest code for the text wins.

ASCII letters are folded to lower case and all other ASCII bytes to a blank before coding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import python_batches, remainder, stored

ORDER = 3
#: Contexts that the tree keeps over all languages: the most frequent ones of any length.
CONTEXTS = 1 << 14
#: Bytes that one numpy batch holds; a longer text goes through in several.
BLOCK = 1 << 20
#: Different (language, gram) pairs that a task holds before it sends them on.
HELD_GRAMS = 1 << 20
#: Contexts whose code lengths are worked out at once.
CHUNK = 512
UNKNOWN = "und"

BLANK = 32
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else BLANK for b in range(256))
SYMBOLS = np.array([BLANK, *range(97, 123), *range(128, 256)])
SYMBOL_OF = np.zeros(256, np.int64)
SYMBOL_OF[SYMBOLS] = np.arange(len(SYMBOLS))
S = len(SYMBOLS)
PAD = b" " * ORDER


def grams(text: bytes) -> np.ndarray:
    """The last ``ORDER`` + 1 symbols at each byte, as one number in base S."""
    seq = SYMBOL_OF[np.frombuffer(PAD + text.translate(FOLD), np.uint8)]
    n = len(seq) - ORDER
    out = seq[:n].copy()
    for k in range(1, ORDER + 1):
        out *= S
        out += seq[k : k + n]
    return out


def _blocks(text: bytes) -> Iterator[bytes]:
    """Pieces of a text, each but the first with the bytes before it as its start."""
    for at in range(0, len(text), BLOCK):
        yield text[max(0, at - ORDER) : at + BLOCK]


def block_grams(text: bytes) -> Iterator[np.ndarray]:
    for i, piece in enumerate(_blocks(text)):
        yield grams(piece)[ORDER if i else 0 :]


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all texts with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        raw: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def settle(lang: str) -> None:
            values, n = np.unique(np.concatenate(raw.pop(lang)), return_counts=True)
            size[lang] = 0
            held.setdefault(lang, []).append((values, n))
            if len(held[lang]) > 4:
                merge(lang)

        def merge(lang: str) -> None:
            values, where = np.unique(np.concatenate([v for v, _ in held[lang]]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n for _, n in held[lang]])).astype(np.int64)
            held[lang] = [(values, n)]

        def out() -> Iterator[pa.RecordBatch]:
            for lang in list(raw):
                settle(lang)
            for lang in list(held):
                merge(lang)
                values, n = held.pop(lang)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(n)], ["lang", "gram", "n"]
                )

        for batch in python_batches(batches):
            for text, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                for part in block_grams(text or b""):
                    raw.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part)
                    if size[lang] >= BLOCK:
                        settle(lang)
            if sum(len(v) for parts in held.values() for v, _ in parts) > HELD_GRAMS:
                yield from out()
        yield from out()

    part = docs.select(text_col, lang_col).mapInArrow(run, "lang string, gram bigint, n bigint")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Trees:
    """The context trees of all languages: counts of (context, symbol), by order."""

    langs: list[str]
    contexts: list[np.ndarray]  # by order: the kept contexts, sorted, as numbers in base S
    counts: list[np.ndarray]  # by order: contexts x S x languages
    prior: np.ndarray  # bits that naming each language costs

    def __getstate__(self) -> dict:
        sparse = [(c.shape, np.flatnonzero(c), c[c > 0]) for c in self.counts]
        return {"langs": self.langs, "contexts": self.contexts, "counts": sparse, "prior": self.prior}

    def __setstate__(self, state: dict) -> None:
        counts = []
        for shape, at, n in state["counts"]:
            full = np.zeros(shape)
            full.flat[at] = n
            counts.append(full)
        self.__dict__.update(state | {"counts": counts})

    @cached_property
    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """(state of each context of ORDER symbols, bits of (state, symbol) x language)."""
        state = np.zeros(S**ORDER, np.int32)
        bits = np.empty((sum(map(len, self.contexts)), S, len(self.langs)))
        first = before = 0
        for order, (contexts, counts) in enumerate(zip(self.contexts, self.counts)):
            for at in range(0, len(contexts), CHUNK):
                some, part = contexts[at : at + CHUNK], counts[at : at + CHUNK]
                total = part.sum(axis=1)[:, None, :]
                kinds = (part > 0).sum(axis=1)[:, None, :]
                if order:
                    base = bits[before + np.searchsorted(self.contexts[order - 1], some % S ** (order - 1))]
                else:
                    base = np.full((1, S, len(self.langs)), np.log2(S))
                with np.errstate(divide="ignore", invalid="ignore"):
                    direct = np.log2(total + kinds) - np.log2(part)
                    escape = np.log2(total + kinds) - np.log2(kinds)
                found = np.where(part > 0, direct, escape + base)
                bits[first + at : first + at + len(some)] = np.where(total == 0, base, found)
            state.reshape(-1, S**order)[:, contexts] = first + np.arange(len(contexts), dtype=np.int32)
            before, first = first, first + len(contexts)
        return state, bits.reshape(-1, len(self.langs))

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Exact bits of the whole text in each language."""
        state, bits = self.lookup
        total = np.zeros(len(self.langs))
        for part in block_grams(text):
            total += bits[state[part // S] * np.int64(S) + part % S].sum(axis=0)
        return total

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not self.langs or not text or not any(c.isalpha() for c in text.decode()):
            return UNKNOWN, 0.0
        bits = self.code_lengths(text) + self.prior
        best = int(np.argmin(bits))
        return self.langs[best], float(1 / np.exp2(bits[best] - bits).sum())


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Trees:
    """Context trees from all rows with a language; the driver gets the kept contexts' counts only."""
    known = docs.where(F.col(lang_col).isNotNull())
    full = stored(gram_counts(known, text_col, lang_col), "grams")
    share = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # one row per language
    langs = sorted(share)
    by_order = full.select(
        "lang", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("gram") % S ** (k + 1)).alias("g")) for k in range(ORDER + 1)])).alias("x")
    ).groupBy("lang", F.col("x.k").alias("k"), F.col("x.g").alias("g")).agg(F.sum("n").alias("n"))
    counts = stored(by_order.withColumn("context", F.floor(F.col("g") / S)), "context-grams")
    totals = counts.groupBy("k", "context").agg(F.sum("n").alias("total"))
    level = F.floor(F.log2("total") * 8)
    floor, room = 1 << 30, CONTEXTS
    for row in sorted(totals.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        room -= row["count"]
        if room < 0:
            break
        floor = row["level"]
    kept = counts.join(totals.where((level >= floor) | (F.col("k") == 0)).select("k", "context"), ["k", "context"])
    rows = kept.select("k", "context", (F.col("g") % S).alias("s"), "lang", "n").toPandas()  # CONTEXTS x S x languages at most
    contexts, tables = [], []
    at_lang = rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    for k in range(ORDER + 1):
        own = (rows["k"] == k).to_numpy()
        found, where = np.unique(rows["context"].to_numpy(np.int64)[own], return_inverse=True)
        if k == 0 and not len(found):
            found = np.zeros(1, np.int64)
        table = np.zeros((len(found), S, len(langs)))
        table[where, rows["s"].to_numpy(np.int64)[own], at_lang[own]] = rows["n"].to_numpy(float)[own]
        contexts.append(found)
        tables.append(table)
    n = np.array([share[x] for x in langs], float)
    return Trees(langs, contexts, tables, -np.log2(n / max(n.sum(), 1.0)))


def identify(docs: DataFrame, trees: Trees, *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in ``keep`` with lang_pred and score of the whole text.

    * Null texts and texts without a letter: ``und``, score 0. Ties go to the first language by name.
    * Repeated rows give equal answers; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        if trees.langs:
            trees.lookup, trees.counts = trees.lookup, []  # only the table is needed from here on
        for batch in python_batches(batches):
            found = [trees.predict(t) for t in batch.column(len(keep)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    picked = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return picked.mapInArrow(run, schema)


def held_out(id_col: str):
    return F.coalesce(remainder(id_col, 3) == 1, F.lit(False))


def label_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) per row; learns from rows whose crc32(id) modulo 3 is not 1. Null ids are trained on."""
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    trees = train(rows.where("not held_out"), text_col="text", lang_col="lang")
    return identify(rows, trees, text_col="text", keep=(id_col, "held_out"))
