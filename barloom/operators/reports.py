"""Statistics and manifests of feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.ranks import exact_percentiles
from barloom.sources.sinks import materialize

PAIRS = (("train", "validation"), ("validation", "test"), ("train", "test"))


def feature_stats(df: DataFrame, features: Sequence[str], *, by: str = "split") -> DataFrame:
    """Per split and feature: count, mean, sample deviation, min, quartiles, max, nulls.

    Splits are too large to sort whole: the moments are one aggregation, the quartiles exact
    by bracketing.
    """
    df = materialize(df.select(by, *features), "features")
    aggs: list[Column] = []
    for c in features:
        aggs += [
            F.count(c).alias(f"{c}_count"),
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_std"),
            F.min(c).cast("double").alias(f"{c}_min"),
            F.max(c).cast("double").alias(f"{c}_max"),
            F.count_if(F.col(c).isNull()).alias(f"{c}_nan_count"),
        ]
    fields = ("count", "mean", "std", "min", "max", "nan_count")
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}_{f}").alias(f) for f in fields]) for c in features]
    )
    moments = df.groupBy(by).agg(*aggs).select(by, F.inline(cells))
    quartiles = exact_percentiles(df, [by], features, [0.25, 0.5, 0.75])
    return moments.join(quartiles, [by, "feature"], "left").select(
        by,
        "feature",
        *fields,
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q75"),
    )


def _shift(a: Column, b: Column) -> Column:
    flat = F.when(F.abs(b) < 1e-10, 0.0).otherwise(100.0)
    return F.when(F.abs(a) > 1e-10, F.lit(100.0) * (b - a) / F.abs(a)).otherwise(flat)


def distribution_shift(stats: DataFrame, *, threshold: float = 10.0) -> DataFrame:
    """Percent change of mean and deviation between splits; above ``threshold`` in size it is flagged.

    ``stats`` is one row per split and feature, so the self join is tiny.
    """
    split_of = lambda name, tag: stats.where(F.col("split") == name).select(
        "feature", F.col("mean").alias(f"mean_{tag}"), F.col("std").alias(f"std_{tag}")
    )
    out = None
    for first, second in PAIRS:
        pair = split_of(first, "1").join(split_of(second, "2"), "feature").withColumn(
            "pair", F.lit(f"{first}_vs_{second}")
        )
        out = pair if out is None else out.unionByName(pair)
    out = out.withColumns(
        {
            "mean_shift_pct": _shift(F.col("mean_1"), F.col("mean_2")),
            "std_shift_pct": _shift(F.col("std_1"), F.col("std_2")),
        }
    )
    big = (F.abs("mean_shift_pct") > threshold) | (F.abs("std_shift_pct") > threshold)
    return out.withColumn("flagged", F.coalesce(big, F.lit(False)))


def feature_manifest(df: DataFrame, tiers: Mapping[str, int]) -> DataFrame:
    """Per symbol: the features with their tier and nulls, rows, columns and nulls in all."""
    wide = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in tiers]
    )
    total = F.lit(0)
    for c in tiers:
        total = total + F.col(f"_{c}")
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.lit(t).alias("tier"), F.col(f"_{c}").alias("nan_count"))
            for c, t in tiers.items()
        ]
    )
    return wide.select(
        "symbol", "row_count", F.lit(len(tiers)).alias("feature_count"), total.alias("total_nan_count"), entries.alias("features")
    )


def tier_counts(manifest: DataFrame) -> DataFrame:
    """Features per tier, the most any symbol has."""
    per_symbol = manifest.select("symbol", F.inline("features")).groupBy("symbol", "tier").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_symbol.groupBy("tier").agg(F.max("n").alias("features"))
