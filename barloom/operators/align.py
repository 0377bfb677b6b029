"""Aligning one series to the dates of another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.blocks import ROWS_PER_BLOCK, carried, in_slices
from barloom.functions.guards import broadcast_if_small
from barloom.functions.rolling import series_window, upto
from barloom.sources.sinks import materialize


def join_features(base: DataFrame, *others: DataFrame, on: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Left join of feature tables on (symbol, date). Features of one source need no join: select them together."""
    for other in others:
        base = base.join(other, list(on), "left")
    return base


def align_exact_ffill(df: DataFrame, market: DataFrame, tickers: dict[str, Column | str]) -> DataFrame:
    """Add one column per entry of ``tickers`` (name -> ticker of the row) with that series' close.

    Only closes dated exactly on a bar enter; later bars repeat the last one seen by the same
    symbol; nothing is filled backwards. All series are filled by one window on ``symbol``.
    """
    closes = market.select(F.col("ticker").alias("_t"), F.col("date").alias("_d"), F.col("close").alias("_c"))
    side = broadcast_if_small(closes)
    for name, ticker in tickers.items():
        t = F.lit(ticker) if isinstance(ticker, str) else ticker
        df = (
            df.withColumn("_want", t)
            .join(side, (F.col("_want") == F.col("_t")) & (F.col("date") == F.col("_d")), "left")
            .withColumnRenamed("_c", name)
            .drop("_want", "_t", "_d")
        )
    w = upto(series_window())
    return df.withColumns({name: F.last(name, True).over(w) for name in tickers})


def align_asof(df: DataFrame, market: DataFrame, ticker: Column | str, *, out: str = "market_close") -> DataFrame:
    """Backward as-of join on daily dates: the latest close dated on or before the bar.

    The as-of value is found once per (ticker, distinct bar date), a group bounded by the
    calendar, and then joined by equality, so bars are never unioned with the market rows.
    """
    t = F.lit(ticker) if isinstance(ticker, str) else ticker
    df = df.withColumn("_t", t)
    wanted = df.select(F.col("_t").alias("ticker"), "date").distinct()
    known = market.select("ticker", "date", F.col("close").alias("_c"))
    both = wanted.withColumn("_c", F.lit(None).cast("double")).withColumn("_ask", F.lit(True)).unionByName(
        known.withColumn("_ask", F.lit(False))
    )
    # Market rows sort before the question on their own date.
    w = Window.partitionBy("ticker").orderBy("date", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    answers = both.withColumn(out, F.last("_c", True).over(w)).where("_ask").select(
        F.col("ticker").alias("_t"), "date", out
    )
    return df.join(broadcast_if_small(answers), ["_t", "date"], "left").drop("_t")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: str,
    order_col: str = "date",
    value_cols: Sequence[str],
    rows_per_slice: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Backward as-of join for series too long for one task (one key may hold a third of the rows).

    Rows of both sides are sorted over all tasks and cut into slices of a fixed number of rows; right rows come before
    left ones of the same instant, and of right rows of one instant the last by a hash of the row counts. Inside a slice
    a local window looks back; what earlier slices know last is carried over a tree of slices.
    """
    keep = [c for c in left.columns if c not in (by, order_col)]
    r = right.select(by, order_col, F.struct(*value_cols).alias("_v")).withColumn("_ask", F.lit(False))
    l = left.select(by, order_col, F.struct(*keep).alias("_row")).withColumn("_ask", F.lit(True))
    both = l.withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType)).unionByName(
        r.withColumn("_row", F.lit(None).cast(l.schema["_row"].dataType))
    )
    both = in_slices(both, symbol_col=by, order_col=order_col, first=["_ask"], rows_per_slice=rows_per_slice)
    tail = both.groupBy(by, "_slice").agg(F.max_by("_v", F.when(~F.col("_ask"), F.col("_at"))).alias("_tail"))
    earlier = carried(materialize(tail, "slice-totals"), "_tail", "_carry", symbol_col=by, last=True)
    local = Window.partitionBy(by, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last("_v", True).over(local), F.col("_carry"))
    return (
        both.join(earlier, [by, "_slice"])
        .withColumn("_found", found)
        .where("_ask")
        .select(by, order_col, "_row.*", *[F.col(f"_found.{c}").alias(c) for c in value_cols])
    )
