"""Mixing sources by temperature.

The weight of a source is its share of all tokens raised to an exponent between 0 (all sources alike) and 1 (as they
come), normalised. The exponent is the largest that reaches a target entropy, raised as far as needed to keep every
source within a limit of repetitions; both are found by bisection on sums over the sources. The weights are then made
real: whole passes over a source, and for the rest of its budget the start of one more permutation of its documents.
Copies are dealt to blocks by their place in these permutations, so every block has the mix of the whole.

No source is sorted or windowed: where a permutation has to stop is found by sums over 1,024 hash ranges, then over
the 1,024 parts of the range that holds the end, and so on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stored
from barloom.llm.quality import words_of

#: Entropy to reach, as a share of that of equal weights.
TARGET_ENTROPY = 0.95
#: Times that a document may be used on average over its source.
MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 20
#: Exponents tried at once, and rounds of narrowing.
SECTIONS = 32
NARROWINGS = 5
RANGE_BITS = 10
RANGE_LEVELS = 3
PLACES = 1 << (RANGE_BITS * RANGE_LEVELS)


@dataclass(frozen=True)
class Mix:
    exponent: float
    norm: float  # sum of share ** exponent
    budget: float  # tokens of the whole mix
    tokens: float  # tokens of all sources

    def weight(self, tokens: Column) -> Column:
        return F.pow(tokens / self.tokens, F.lit(self.exponent)) / self.norm


def _sums(sources: DataFrame, total: float, exponents: list[float]) -> list[tuple[float, float]]:
    """(sum of p**a, entropy of the weights) for each exponent a."""
    p = F.col("tokens") / total
    found = sources.agg(
        *[F.sum(F.pow(p, F.lit(a))).alias(f"z{i}") for i, a in enumerate(exponents)],
        *[F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}") for i, a in enumerate(exponents)],
    ).first()
    return [(found[f"z{i}"], math.log(found[f"z{i}"]) - a * found[f"l{i}"] / found[f"z{i}"]) for i, a in enumerate(exponents)]


def choose_mix(
    sources: DataFrame, *, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = None
) -> Mix | None:
    """The mix of ``sources`` (key, tokens > 0); None if there are none.

    Without a ``budget`` it is the smallest with which no source is used less than once.
    """
    whole = sources.agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if not whole["n"]:
        return None
    total, goal = float(whole["t"]), target_entropy * math.log(whole["n"])
    low, high = 0.0, 1.0
    for _ in range(NARROWINGS):
        tried = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        reach = [h >= goal - 1e-12 for _, h in _sums(sources, total, tried)]  # falls as the exponent grows
        last = max((i for i, ok in enumerate(reach) if ok), default=0)
        low, high = tried[last], tried[min(last + 1, SECTIONS)]

    def repeats(a: float) -> float:
        """Of the source that is used most often, which is the smallest."""
        if budget is None:
            return (whole["most"] / whole["least"]) ** (1 - a)
        return budget / total * (whole["least"] / total) ** (a - 1) / _sums(sources, total, [a])[0][0]

    exponent = low
    if repeats(exponent) > max_repeats:
        high = 1.0
        for _ in range(40):
            middle = (exponent + high) / 2
            exponent, high = (exponent, middle) if repeats(middle) <= max_repeats else (middle, high)
        exponent = high
    norm = _sums(sources, total, [exponent])[0][0]
    if budget is None:
        share = whole["most"] / total
        budget = norm * total * share ** (1 - exponent)
    return Mix(exponent, norm, budget, total)


def _place(seed: Column) -> Column:
    """Where a document stands in the permutation of that number: 0 to PLACES - 1."""
    return F.pmod(F.xxhash64("id", "hash", seed), F.lit(PLACES))


def _ends(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with ``end``: the place before which the last, partial permutation holds ``rest`` tokens at most."""
    asked = sources.select("key", "rest", F.lit(0).cast("bigint").alias("end"))
    for level in range(1, RANGE_LEVELS + 1):
        width = PLACES >> (RANGE_BITS * level)
        outer = width << RANGE_BITS
        inside = docs.join(asked, "key").where((F.col("place") >= F.col("end")) & (F.col("place") < F.col("end") + outer))
        sums = inside.groupBy("key", "rest", "end", F.floor((F.col("place") - F.col("end")) / width).alias("part")).agg(F.sum("tokens").alias("t"))
        # 1,024 rows of a source at most
        running = F.sum("t").over(Window.partitionBy("key").orderBy("part"))
        passed = sums.withColumn("sum", running).groupBy("key").agg(
            F.coalesce(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum"))), F.lit(0)).alias("used"),
            F.min(F.when(F.col("sum") > F.col("rest"), F.col("part"))).alias("next"),
        )
        asked = stored(
            asked.join(passed, "key", "left").select(
                "key",
                (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"),
                (F.col("end") + F.coalesce("next", F.lit((1 << RANGE_BITS) if level == 1 else (1 << RANGE_BITS) - 1)) * width).alias("end"),
            ),
            "ends",
        )
    ends = asked.select("key", F.col("end").alias("found"))
    return sources.join(ends, "key").withColumn("end", F.when(F.col("rest") < 1, 0).otherwise(F.col("found")))


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """``docs``, each row as often as the mix uses it, with n_tokens, epoch, block, slot and weight (of the source).

    Tokens are words. Blocks count from 0 and hold about ``block_tokens`` each; ``slot`` orders a block.

    * A null source is a source of its own. Null and blank texts have no tokens; a source without tokens is used once.
    * Of a source's last permutation documents are taken while its budget lasts, so a source ends below its budget by
      less than one document (and those that share its place among ``PLACES``).
    * Repeated rows stand in the same places and are used alike. An empty table gives no rows. Other columns stay.
    """
    source_key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("key")
    columns = docs.columns
    known = stored(
        docs.select(source_key, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.size(words_of(F.col(text_col))).cast("bigint").alias("tokens")),
        "mix-documents",
    )
    sources = stored(known.groupBy("key").agg(F.sum("tokens").alias("tokens")), "sources")
    mix = choose_mix(sources.where("tokens > 0"), target_entropy=target_entropy, max_repeats=max_repeats, budget=budget) or Mix(1.0, 1.0, 0.0, 1.0)
    weight = F.when(F.col("tokens") > 0, mix.weight(F.col("tokens"))).otherwise(0.0)
    planned = sources.withColumn("weight", weight).withColumn("wanted", F.col("weight") * mix.budget)
    # The largest source is used once exactly; keep rounding from taking a document from it.
    uses = F.when(F.col("tokens") > 0, F.col("wanted") / F.col("tokens") + 1e-9).otherwise(1.0)
    planned = planned.withColumn("uses", uses).withColumn("epochs", F.floor("uses")).withColumn("rest", (F.col("uses") - F.col("epochs")) * F.col("tokens"))
    placed = known.select("key", "tokens", _place(F.lit(-1)).alias("place"))
    plan = stored(_ends(placed, planned).select("key", "weight", "uses", "epochs", "end"), "mix-plan")
    blocks = max(1, round(mix.budget / block_tokens))
    marked = docs.select(
        *[F.col(c) for c in columns],
        F.struct(source_key, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.size(words_of(F.col(text_col))).cast("bigint").alias("n")).alias("_m"),
    )
    joined = marked.join(plan.select(F.col("key").alias("_key"), F.struct("weight", "uses", "epochs", "end").alias("_p")), F.col("_m.key") == F.col("_key"))

    def place(seed: Column) -> Column:
        return F.pmod(F.xxhash64("_m.id", "_m.hash", seed), F.lit(PLACES))

    copies = F.col("_p.epochs") + F.when(place(F.lit(-1)) < F.col("_p.end"), 1).otherwise(0)
    used = joined.withColumn("_copies", copies.cast("int")).where("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    own = F.when(F.col("_epoch") < F.col("_p.epochs"), place(F.col("_epoch"))).otherwise(place(F.lit(-1)))
    at = (F.col("_epoch") + own / PLACES) / F.col("_p.uses")
    extra = {
        "n_tokens": F.col("_m.n"),
        "epoch": F.col("_epoch"),
        "block": F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("bigint"),
        "slot": F.xxhash64("_m.id", "_m.hash", F.col("_epoch"), F.lit(-2)),
        "weight": F.col("_p.weight"),
    }
    return used.select(*[F.col(c) for c in columns if c not in extra], *[x.alias(c) for c, x in extra.items()])
