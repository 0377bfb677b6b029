"""Chronological splits on a calendar shared by all symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


def split_cutoffs(
    df: DataFrame, *, train_ratio: float = 0.70, val_ratio: float = 0.15, date_col: str = "date"
) -> DataFrame:
    """One row with the first and last date of each split.

    The sorted distinct dates form one array: days, not rows, so it is bounded by the calendar.
    """
    if not (0 < train_ratio < 1 and 0 < val_ratio < 1 and train_ratio + val_ratio < 1):
        raise ValueError("train_ratio and val_ratio must be positive and leave room for a test split")
    days = df.agg(F.array_sort(F.collect_set(F.to_date(date_col))).alias("_days"))
    n = F.size("_days")
    train = F.greatest(F.lit(1), F.floor(n * F.lit(train_ratio)).cast("int"))
    val = F.greatest(F.lit(1), F.floor(n * F.lit(val_ratio)).cast("int"))
    days = days.withColumns({"_n": n, "_t": train, "_v": val})
    tight = F.col("_t") + F.col("_v") >= F.col("_n")
    days = days.withColumn(
        "_t", F.when(tight, F.greatest(F.lit(1), F.least(F.col("_t"), F.col("_n") - 2))).otherwise(F.col("_t"))
    ).withColumn(
        "_v",
        F.when(
            F.col("_t") + F.col("_v") >= F.col("_n"),
            F.greatest(F.lit(1), F.least(F.col("_v"), F.col("_n") - F.col("_t") - 1)),
        ).otherwise(F.col("_v")),
    )
    few = F.raise_error(F.lit("at least three distinct dates are needed to split"))
    day = lambda i: F.when(F.col("_n") < 3, few.cast("date")).otherwise(F.try_element_at("_days", i))
    t, v, last = F.col("_t"), F.col("_t") + F.col("_v"), F.col("_n")
    return days.select(
        day(F.lit(1)).alias("train_start_date"),
        day(t).alias("train_end_date"),
        day(t + 1).alias("val_start_date"),
        day(v).alias("val_end_date"),
        day(v + 1).alias("test_start_date"),
        day(last).alias("test_end_date"),
    )


def chrono_split(
    df: DataFrame, *, train_ratio: float = 0.70, val_ratio: float = 0.15, date_col: str = "date"
) -> DataFrame:
    """Label every row train, validation or test by shared date cut-offs, which are looked up at once (one row)."""
    cut = split_cutoffs(df, train_ratio=train_ratio, val_ratio=val_ratio, date_col=date_col).first()
    day = F.to_date(date_col)
    label = F.when(day <= F.lit(cut["train_end_date"]), "train").when(day <= F.lit(cut["val_end_date"]), "validation")
    return df.withColumn("split", label.otherwise("test"))


def split_metadata(df: DataFrame) -> DataFrame:
    """Rows and date range per split and symbol, and per split ('ALL')."""
    return (
        df.rollup("split", "symbol")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("date").alias("start_date"),
            F.max("date").alias("end_date"),
            F.grouping_id().alias("_level"),
        )
        .where(F.col("_level") < 3)
        .withColumn("symbol", F.when(F.col("_level") == 1, "ALL").otherwise(F.col("symbol")))
        .drop("_level")
    )


def split_verify(df: DataFrame) -> DataFrame:
    """Per symbol: dates in more than one split, and whether the ranges follow each other."""
    per_date = df.groupBy("symbol", "date").agg(
        F.count_distinct("split").alias("_n"), F.max("split").alias("_hi"), F.min("split").alias("_lo")
    )

    def edge(fn, name: str) -> Column:
        return fn(F.when((F.col("_hi") == name) | (F.col("_lo") == name), F.col("date")))

    ranges = per_date.groupBy("symbol").agg(
        F.count_if(F.col("_n") > 1).alias("shared_dates"),
        edge(F.max, "train").alias("_train_end"),
        edge(F.min, "validation").alias("_val_start"),
        edge(F.max, "validation").alias("_val_end"),
        edge(F.min, "test").alias("_test_start"),
    )
    follows = lambda a, b: F.coalesce(F.col(a) < F.col(b), F.lit(True))
    return ranges.select(
        "symbol",
        "shared_dates",
        (
            (F.col("shared_dates") == 0)
            & follows("_train_end", "_val_start")
            & follows("_val_end", "_test_start")
            & follows("_train_end", "_test_start")
        ).alias("no_leakage"),
    )


def target_return(df: DataFrame, *, column: str = "simple_return") -> DataFrame:
    """Add ``target``: the return of the symbol's next bar."""
    return df.withColumn("target", F.lead(column).over(Window.partitionBy("symbol").orderBy("date")))
