"""Indicators of the last bars of each symbol, and the rule-based signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import ratio


def latest_indicators(df: DataFrame, *, bars: int = 60) -> DataFrame:
    """One row per symbol from its last ``bars`` bars.

    Population deviations, simple-mean RSI, and weighted (not recursive) exponential means:
    the mean over the kept bars with weights (1 - alpha)**age.
    """
    latest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    kept = df.withColumn("_age", F.row_number().over(latest) - 1).where(F.col("_age") < bars)
    older = F.lead("close").over(latest)
    kept = kept.withColumns({"_diff": F.col("close") - older, "_ret": ratio(F.col("close") - older, older)})

    def last(n: int, value: Column) -> Column:
        return F.when(F.col("_age") < n, value)

    def weighted(span: int) -> Column:
        w = F.pow(F.lit(1.0 - 2.0 / (span + 1.0)), F.col("_age"))
        return ratio(F.sum(F.col("close") * w), F.sum(w))

    def at(age: int, column: str) -> Column:
        return F.max(F.when(F.col("_age") == age, F.col(column)))

    wide = kept.groupBy("symbol").agg(
        F.max("date").alias("date"),
        at(0, "close").alias("close"),
        F.avg(last(5, F.col("_ret"))).alias("returns_5d"),
        F.avg(last(20, F.col("_ret"))).alias("returns_20d"),
        F.stddev_pop(last(20, F.col("_ret"))).alias("volatility"),
        F.avg(F.when(F.col("_diff").isNotNull(), last(14, F.greatest("_diff", F.lit(0.0))))).alias("_gain"),
        F.avg(F.when(F.col("_diff").isNotNull(), last(14, F.greatest(-F.col("_diff"), F.lit(0.0))))).alias("_loss"),
        (weighted(12) - weighted(26)).alias("macd"),
        F.avg(last(20, F.col("close"))).alias("_sma"),
        F.stddev_pop(last(20, F.col("close"))).alias("_std"),
        (at(0, "close") - at(4, "close")).alias("momentum"),
        ratio(at(0, "volume"), F.avg(last(20, F.col("volume")))).alias("volume_ratio"),
    )
    rs = F.coalesce(ratio(F.col("_gain"), F.col("_loss")), F.lit(0.0))
    upper, lower = F.col("_sma") + 2 * F.col("_std"), F.col("_sma") - 2 * F.col("_std")
    return wide.withColumns(
        {
            "rsi_14": 100.0 - 100.0 / (1.0 + rs),
            "bb_upper": upper,
            "bb_lower": lower,
            "bb_position": ratio(F.col("close") - lower, upper - lower),
        }
    ).drop("_gain", "_loss", "_sma", "_std")


def signal_score(indicators: DataFrame) -> DataFrame:
    """Score, confidence, recommendation, reasons and predicted price from the indicators."""
    rsi, macd, bb = F.col("rsi_14"), F.col("macd"), F.col("bb_position")
    momentum, volume = F.col("momentum"), F.col("volume_ratio")
    points = [
        F.when(rsi < 30, 1.0).when(rsi > 70, -1.0).when(rsi < 50, 0.3).otherwise(-0.3),
        F.when(macd > 0, 0.5).otherwise(-0.5),
        F.when(bb < 0.2, 0.8).when(bb > 0.8, -0.8).otherwise(0.0),
        F.when(momentum > 0, 0.4).otherwise(-0.4),
        F.when(volume > 1.2, 0.2).otherwise(0.0),
    ]
    reasons = [
        F.when(rsi < 30, "RSI oversold").when(rsi > 70, "RSI overbought").when(rsi < 50, "RSI downtrend").otherwise(
            "RSI uptrend"
        ),
        F.when(macd > 0, "MACD positive").otherwise("MACD negative"),
        F.when(bb < 0.2, "Near lower band").when(bb > 0.8, "Near upper band"),
        F.when(momentum > 0, "Positive momentum").otherwise("Negative momentum"),
        F.when(volume > 1.2, "High volume"),
    ]
    score = points[0]
    for p in points[1:]:
        score = score + p
    s = F.col("score")
    return indicators.withColumn("score", score).withColumns(
        {
            "confidence": F.greatest(F.lit(0.55), F.least(F.lit(0.95), 1.0 / (1.0 + F.exp(-s)))),
            "recommendation": F.when(s > 0.5, "BUY").when(s < -0.5, "SELL").otherwise("HOLD"),
            "signals": F.array_compact(F.array(*reasons)),
            "predicted_price": F.col("close") * (1.0 + F.col("returns_5d")),
        }
    )
