"""Language-model scores by a hidden Markov model over word classes.

The most frequent words are classes of their own; every other word belongs to one of ``TAIL_CLASSES`` classes by its
ending, and has its share of the class by its count. A hidden state emits a class, so the model stays a fixed size while
word counts cover the whole corpus. Training starts from the pair counts of neighbouring classes over all training
documents and then runs Baum-Welch: each task sends back expected counts, Spark adds them up, the driver holds the
(states x classes) table only. The scaled forward recursion over whole documents gives the exact likelihood.

Counts of words are exact for every word: ``HEAD_WORDS`` frequent ones at most are sent to the tasks, the others are
looked up by a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import python_batches, remainder, stored

STATES = 8
PASSES = 2
HEAD_WORDS = 1 << 18
OWN_CLASSES = 1 << 14
TAIL_CLASSES = 1 << 10
ENDING_BYTES = 3
#: Neighbouring pairs are counted over this many coarse classes.
COARSE = 256
COARSE_OWN = 160
PAIR_ROUNDS = 150
#: Baum-Welch cuts training documents into sequences of at most this many tokens; scoring cuts nothing.
SEGMENT = 512
#: Tokens that one numpy batch holds.
TOKENS = 1 << 19
COUNTER_WORDS = 400_000

END = OWN_CLASSES + TAIL_CLASSES
CLASSES = END + 1


def _texts(column: pa.Array) -> list[list[bytes]]:
    """The words of each text, A-Z in lower case; none for null."""
    return [(t or b"").lower().split() for t in column.cast(pa.binary()).to_pylist()]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts. Tasks count before the shuffle, in a bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(seen), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in python_batches(batches):
            for words in _texts(batch.column(0)):
                seen.update(words)
            if len(seen) > COUNTER_WORDS:
                yield out()
                seen.clear()
        yield out()

    part = docs.select(text_col).mapInArrow(run, "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def ending_class(word: bytes) -> int:
    return OWN_CLASSES + (zlib.crc32(word[-ENDING_BYTES:]) & (TAIL_CLASSES - 1))


def _ending_class(word: Column) -> Column:
    ending = F.substring(word.cast("binary"), -ENDING_BYTES, ENDING_BYTES)
    return (F.crc32(ending) % TAIL_CLASSES + OWN_CLASSES).cast("int")


@dataclass
class Lexicon:
    """Frequent words with their class, and the size of each class."""

    words: dict[bytes, int]
    log_count: np.ndarray  # log10(c + 1) by head word
    code: np.ndarray  # class by head word
    class_count: np.ndarray  # training tokens by class
    log_norm: np.ndarray  # log10 of what a count of the class is divided by; 0 for classes of one word
    n_docs: int
    tokens: int
    distinct: int

    @property
    def log_total(self) -> float:
        return math.log10(self.tokens + self.distinct + 1)


def lexicon(counts: DataFrame, n_docs: int) -> Lexicon:
    """From (word, n) and the number of training documents."""
    level = F.floor(F.log2("n") * 16)
    shares = counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()  # some hundred levels
    floor, room = 1 << 30, HEAD_WORDS
    for row in sorted(shares, key=lambda r: -r["level"]):
        room -= row["k"]
        if room < 0:
            break
        floor = row["level"]
    head = [(r["word"].encode(), r["n"]) for r in counts.where(level >= floor).collect()]  # HEAD_WORDS at most
    head.sort(key=lambda x: (-x[1], x[0]))
    own = min(OWN_CLASSES, len(head))
    code = np.array([i if i < own else ending_class(w) for i, (w, _) in enumerate(head)], np.int32)
    by_class = counts.groupBy(_ending_class(F.col("word")).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    count, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in by_class.collect():  # TAIL_CLASSES rows at most
        count[row["c"]], kinds[row["c"]] = row["n"], row["v"]
    tokens, distinct = int(count.sum()) + n_docs, int(kinds.sum()) + (n_docs > 0)
    for i, (w, n) in enumerate(head[:own]):
        count[i] = n
        count[ending_class(w)] -= n
        kinds[ending_class(w)] -= 1
    count[END] = n_docs
    norm = np.zeros(CLASSES)
    norm[OWN_CLASSES:END] = np.log10(count[OWN_CLASSES:END] + kinds[OWN_CLASSES:END] + 1)
    return Lexicon(
        {w: i for i, (w, _) in enumerate(head)},
        np.log10(np.array([n for _, n in head], float) + 1),
        code,
        count,
        norm,
        n_docs,
        tokens,
        distinct,
    )


ENCODED = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, inside double, codes binary, tail array<string>"


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Documents (id, held_out, text) as class sequences.

    ``base`` sums log10(c + 1) of head words and the end; ``inside`` sums the log shares of words in their classes,
    of which words in ``tail`` (outside the head) still lack log10(c + 1).
    """
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        get = lex.words.get
        log_end, end_known = math.log10(lex.n_docs + 1), int(lex.n_docs > 0)
        for batch in python_batches(batches):
            n, known, base, inside, codes, tail = [], [], [], [], [], []
            for words in _texts(batch.column(2)):
                at = np.array([get(w, -1) for w in words], np.int32)
                rare = np.flatnonzero(at < 0)
                code = np.empty(len(words) + 1, np.uint16)
                code[:-1] = lex.code[at] if len(lex.code) else 0
                code[-1] = END
                others = [words[i] for i in rare.tolist()]
                code[rare] = [ending_class(w) for w in others]
                head = at[at >= 0]
                log_head = lex.log_count[head]
                n.append(len(words) + 1)
                known.append(len(head) + end_known)
                base.append(float(log_head.sum()) + log_end)
                inside.append(float(log_head[lex.code[head] >= OWN_CLASSES].sum() - lex.log_norm[code].sum()))
                codes.append(code.tobytes())
                tail.append(others)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(inside, pa.float64()),
                    pa.array(codes, pa.binary()),
                    pa.array(tail, pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                ],
                ["id", "held_out", "n_tokens", "n_known", "base", "inside", "codes", "tail"],
            )

    return docs.mapInArrow(run, ENCODED)


def coarse_classes() -> np.ndarray:
    """Coarse class of each class."""
    out = np.arange(CLASSES)
    rest = out >= COARSE_OWN
    out[rest] = COARSE_OWN + out[rest] % (COARSE - COARSE_OWN - 1)
    out[END] = COARSE - 1
    return out


def pair_counts(encoded: DataFrame) -> np.ndarray:
    """How often each coarse class follows each other, over all training documents."""
    coarse = coarse_classes().astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COARSE * COARSE, np.int64)
        for batch in batches:
            for codes in batch.column(0).to_pylist():
                seq = coarse[np.frombuffer(codes, np.uint16)]
                np.add.at(total, seq[:-1] * COARSE + seq[1:], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["pair", "n"])

    out = np.zeros(COARSE * COARSE)
    for row in encoded.select("codes").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[row["pair"]] = row["n"]
    return out.reshape(COARSE, COARSE)


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # states x classes


def _rows(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def first_model(pairs: np.ndarray, class_count: np.ndarray, states: int = STATES, seed: int = 1) -> Model:
    """A model whose pairs of neighbours follow the pair counts, by expectation maximisation on them."""
    rng = np.random.default_rng(seed)
    pairs = pairs + 1e-3
    share = pairs.sum(axis=0) + pairs.sum(axis=1)
    emit = _rows(share / share.sum() * (0.5 + rng.random((states, COARSE))))
    joint = np.eye(states) + 0.5 * rng.random((states, states))
    joint /= joint.sum()
    for _ in range(PAIR_ROUNDS):
        ratio = pairs / np.maximum(emit.T @ joint @ emit, 1e-300)
        left, right = joint @ emit @ ratio.T, joint.T @ emit @ ratio
        after = joint * (emit @ ratio @ emit.T)
        emit = _rows(emit * (left + right) + 1e-9)
        joint = after / after.sum()
    coarse = coarse_classes()
    prior = class_count + 1.0
    within = prior / np.bincount(coarse, prior, COARSE)[coarse]
    return Model(joint.sum(axis=1), _rows(joint + 1e-9), _rows(emit[:, coarse] * within))


def _packed(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences by falling length, token t of all of them side by side: the tokens, and how many sequences reach t."""
    seqs = sorted(seqs, key=len, reverse=True)
    lengths = np.array([len(s) for s in seqs])
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    where = np.concatenate([[0], np.cumsum(live)])
    flat = np.concatenate(seqs)
    t = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.empty(len(flat), np.int64)
    out[where[t] + np.repeat(np.arange(len(seqs)), lengths)] = flat
    return out, where


def expected(seqs: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, steps and emissions (classes x states) of the sequences."""
    tokens, where = _packed(seqs)
    states = len(model.start)
    seen = np.ascontiguousarray(model.emit.T)[tokens]
    alpha = np.empty_like(seen)
    now = model.start
    for t in range(len(where) - 1):
        a, b = where[t], where[t + 1]
        now = (now[: b - a] @ model.step if t else now) * seen[a:b]
        now /= now.sum(axis=1, keepdims=True)
        alpha[a:b] = now
    steps = np.zeros((states, states))
    beta = np.ones((where[-1] - where[-2], states))
    gamma = alpha  # overwritten from the end
    for t in range(len(where) - 2, 0, -1):
        a, b, before = where[t], where[t + 1], where[t - 1]
        ahead = seen[a:b] * beta
        past = alpha[before : before + b - a].copy()
        mass = (past @ model.step * ahead).sum(axis=1, keepdims=True)
        ahead /= mass
        steps += past.T @ ahead
        back = np.ones((a - before, states))
        back[: b - a] = ahead @ model.step.T
        post = alpha[before:a] * back
        gamma[before:a] = post / post.sum(axis=1, keepdims=True)
        beta = back
    emissions = np.stack([np.bincount(tokens, gamma[:, k], CLASSES) for k in range(states)], axis=1)
    return gamma[: where[1]].sum(axis=0), steps * model.step, emissions


def baum_welch(encoded: DataFrame, model: Model, class_count: np.ndarray) -> Model:
    """One pass over all training documents; tasks send sums, Spark adds them."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model)
    states = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        start, steps, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states))
        held: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                a, b, c = expected(held, model)
                start[:] += a
                steps[:] += b
                emissions[:] += c
                held.clear()
                size = 0

        for batch in batches:
            for codes in batch.column(0).to_pylist():
                seq = np.frombuffer(codes, np.uint16)
                for at in range(0, len(seq), SEGMENT):
                    held.append(seq[at : at + SEGMENT])
                    size += len(held[-1])
                    if size >= TOKENS:
                        flush()
        flush()
        rows = np.concatenate([emissions, steps, start[None]])
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64())] + [pa.array(rows[some, k]) for k in range(states)],
            ["row"] + [f"s{k}" for k in range(states)],
        )

    names = [f"s{k}" for k in range(states)]
    sums = (
        encoded.select("codes")
        .mapInArrow(run, "row bigint, " + ", ".join(f"{c} double" for c in names))
        .groupBy("row")
        .agg(*[F.sum(c).alias(c) for c in names])
    )
    total = np.zeros((CLASSES + states + 1, states))
    for row in sums.collect():  # one row per class at most
        total[row["row"]] = [row[c] for c in names]
    shared.unpersist()
    prior = (class_count + 1.0) / (class_count + 1.0).sum()
    return Model(
        _rows(total[-1] + 1.0), _rows(total[CLASSES:-1] + 1.0), _rows(total[:CLASSES].T + prior * 10.0)
    )


def log_likelihoods(seqs: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 probability of each whole sequence by the scaled forward recursion."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    tokens, where = _packed([seqs[i] for i in order])
    table = np.ascontiguousarray(model.emit.T)
    out = np.zeros(len(seqs))
    now = model.start
    for t in range(len(where) - 1):
        a, b = where[t], where[t + 1]
        now = (now[: b - a] @ model.step if t else now) * table[tokens[a:b]]
        scale = now.sum(axis=1, keepdims=True)
        now /= scale
        out[: b - a] += np.log10(scale[:, 0])
    back = np.empty(len(seqs))
    back[order] = out
    return back


def forward(encoded: DataFrame, model: Model) -> DataFrame:
    """(row, id, held_out, n_tokens, n_known, base, inside, chain): ``chain`` is the log likelihood of the classes."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kept = ["row", "id", "held_out", "n_tokens", "n_known", "base", "inside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            tables = pa.Table.from_batches(held).combine_chunks()
            seqs = [np.frombuffer(c, np.uint16) for c in tables.column("codes").to_pylist()]
            scores = log_likelihoods(seqs, shared.value)
            done = tables.drop_columns(["codes"]).append_column("chain", pa.array(scores))
            return done.combine_chunks().to_batches()[0]

        for batch in python_batches(batches):
            held.append(batch)
            size += batch.column("codes").nbytes // 2
            if size >= 8 * TOKENS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    schema = "row bigint, id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, inside double, chain double"
    return encoded.select(*kept, "codes").mapInArrow(run, schema)


def score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2,
    states: int = STATES, passes: int = PASSES,
) -> DataFrame:
    """One row per row of ``docs``: (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from the rows whose crc32(id) modulo ``modulus`` is not ``held``; a null id is never held out.

    * A null, empty or blank text is its end token alone. Repeated rows count, and are scored, each time.
    * With no training rows no token is known: base_score is 0 and the model knows only its uniform start.
    * An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(remainder(id_col, modulus) == held, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    counts = stored(word_counts(rows.where("not held_out")), "word-counts")
    lex = lexicon(counts, rows.where("not held_out").count())
    encoded = stored(encode(rows, lex).withColumn("row", F.monotonically_increasing_id()), "encoded")
    training = encoded.where("not held_out")
    model = first_model(pair_counts(training), lex.class_count, states)
    for _ in range(passes):
        model = baum_welch(training, model, lex.class_count)
    rare = encoded.select("row", F.explode("tail").alias("word")).join(counts, "word")
    rest = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare"), F.count("*").alias("rare_known"))
    rare_sum = F.coalesce("rare", F.lit(0.0))
    return (
        forward(encoded, model)
        .join(rest, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(lex.tokens).cast("bigint").alias("train_tokens"),
            (F.col("base") + rare_sum - F.col("n_tokens") * lex.log_total).alias("base_score"),
            (F.col("chain") + F.col("inside") + rare_sum).alias("score"),
        )
    )
