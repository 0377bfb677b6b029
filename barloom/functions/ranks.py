"""Exact ranks and percentiles of groups too large for one task.

A group here is a whole split, or all rows of a model. Ranks need only the different values and how often they occur:
these are counted map-side and numbered along slices of their order, so neither many rows nor a frequent value meet in a
task. Percentiles bracket the wanted ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.blocks import ROWS_PER_BLOCK, running_total
from barloom.functions.guards import broadcast_if_small


def average_ranks(
    df: DataFrame, groups: Sequence[str], ranks: Mapping[str, str], *, rows_per_slice: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Add the average rank of each value column within ``groups`` (``ranks``: column -> new column); NULLs have none."""
    for c, out in ranks.items():
        values = df.where(F.col(c).isNotNull()).groupBy(*groups, c).agg(F.count(F.lit(1)).alias("_n"))
        key = F.concat_ws("\u0001", *[F.coalesce(F.col(g).cast("string"), F.lit("\u0000")) for g in groups])
        upto = running_total(values.withColumn("_g", key), F.col("_n"), "_upto", symbol_col="_g", order_col=c, rows_per_slice=rows_per_slice)
        # Of n equal values up to the upto-th the average rank lies (n - 1) / 2 below the last.
        ranked = upto.select(*groups, c, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
        df = df.join(ranked, [*groups, c], "left")
    return df


def exact_percentiles(
    df: DataFrame,
    groups: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    accuracy: int = 10_000,
) -> DataFrame:
    """(groups, feature, q: array) with linearly interpolated percentiles, exact at any size.

    A quantile sketch brackets every wanted rank. One more pass counts what lies below the
    bracket and ranks only the distinct values inside it, some 4 / accuracy of the rows.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*groups, F.inline(cells)).where(F.col("v").isNotNull())
    keys = [*groups, "feature"]
    edge = 2.0 / accuracy
    lows = [max(p - edge, 0.0) for p in probs]
    highs = [min(p + edge, 1.0) for p in probs]
    sketch = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("v").alias("lo0"),
        F.max("v").alias("hi1"),
        F.percentile_approx("v", lows, accuracy).alias("lo"),
        F.percentile_approx("v", highs, accuracy).alias("hi"),
    )
    targets = sketch.select(
        *keys,
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"),
                        (F.when(F.lit(p - edge <= 0), F.col("lo0")).otherwise(F.col("lo")[i])).alias("a"),
                        (F.when(F.lit(p + edge >= 1), F.col("hi1")).otherwise(F.col("hi")[i])).alias("b"),
                        (F.lit(float(p)) * (F.col("n") - 1)).alias("at"),
                    )
                    for i, p in enumerate(probs)
                ]
            )
        ),
    )
    # Groups x features x probs rows.
    hit = long.join(broadcast_if_small(targets), keys)
    zone = F.when(F.col("v") < F.col("a"), -1).when(F.col("v") > F.col("b"), 1).otherwise(0)
    # What lies outside the bracket collapses to one row a side, which keeps its nearest value.
    counted = (
        hit.withColumn("zone", zone)
        .groupBy(*keys, "i", "at", "zone", F.when(F.col("zone") == 0, F.col("v")).alias("at_v"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    )
    w = Window.partitionBy(*keys, "i").orderBy("zone", "at_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.sum("c").over(w))
    first, second = F.floor("at"), F.ceil("at")

    def value_at(rank: Column) -> Column:
        start = F.col("upto") - F.col("c")
        inside = (F.col("zone") == 0) & (F.col("upto") > rank) & (start <= rank)
        return F.max(
            F.when(inside, F.col("at_v"))
            .when((F.col("zone") == -1) & (rank == F.col("upto") - 1), F.col("most"))
            .when((F.col("zone") == 1) & (rank == start), F.col("least"))
        )

    picked = placed.groupBy(*keys, "i", "at").agg(value_at(first).alias("x"), value_at(second).alias("y"))
    frac = F.col("at") - F.floor("at")
    known = F.when(
        F.col("x").isNull() | F.col("y").isNull(), F.raise_error(F.lit("a percentile fell outside its bracket"))
    ).otherwise(F.col("x") + (F.col("y") - F.col("x")) * frac)
    return (
        picked.withColumn("q", known)
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("q"))
    )
