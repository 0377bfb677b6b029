"""Registered queries of feature modules: a custom operator, rules of modules, causality over several inputs, order of ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import cross_asset, modules, quality, signal
from barloom.operators import features as ft
from barloom.plans.entries import Entry, entry, same
from barloom.plans.oracle import sql
from barloom.sources import bars as src


def _day_share(frames: modules.Frames) -> DataFrame:
    """A symbol's share of the day's volume over all symbols: an aggregation and a join, not a window of the series."""
    bars = frames[modules.BARS]
    days = bars.groupBy("date").agg(F.sum("volume").alias("_day"))
    return bars.join(days, "date").withColumn("volume_share", F.try_divide(F.col("volume"), F.col("_day"))).drop("_day")


def _next_close(frames: modules.Frames) -> DataFrame:
    """Looks a bar ahead, and must be found out."""
    return frames[modules.BARS].withColumn("planted_leak", F.lead("close").over(Window.partitionBy("symbol").orderBy("date")))


def _late_market(frames: modules.Frames) -> DataFrame:
    """The last close of the whole market series on every bar: it leaks through the second input only."""
    last = frames["market"].agg(F.max_by("close", F.struct("date", "ticker")).alias("late_market"))
    return frames[modules.BARS].join(F.broadcast(last))  # one row


def _cross(frames: modules.Frames) -> DataFrame:
    return cross_asset.market_features(frames[modules.BARS], frames["market"], frames["registry"])


def _on_bars(op):
    return lambda frames: op(frames[modules.BARS])


def registry() -> modules.ModuleRegistry:
    share = F.col("volume_share")
    return modules.ModuleRegistry(
        [
            modules.from_feature(ft.returns(), {"above_minus_one": F.col("simple_return") > -1, "below_a_tenth": F.col("simple_return") < 0.1}),
            modules.from_feature(ft.rsi(), {"within_bounds": F.col("rsi_14").between(0, 100)}),
            modules.Module("day_share", 3, ("volume_share",), _day_share, {"is_a_share": share.between(0, 1), "is_small": share < 0.2}),
        ]
    )


def causal_registry() -> modules.ModuleRegistry:
    return modules.ModuleRegistry(
        [
            modules.Module("kalman", 4, KALMAN, _on_bars(signal.kalman)),
            modules.Module("wavelet", 4, WAVELET, _on_bars(signal.wavelet)),
            modules.Module("ssa", 4, SSA, _on_bars(signal.ssa)),
            modules.Module("cross_asset", 3, CROSS, _cross),
            modules.Module("day_share", 3, ("volume_share",), _day_share),
            modules.Module("leak", 3, ("planted_leak",), _next_close),
            modules.Module("late_market", 3, ("late_market",), _late_market),
        ]
    )


KALMAN = ("kalman_level", "kalman_innovation_zscore")
WAVELET = ("wavelet_approximation", "wavelet_detail_1", "wavelet_detail_2", "wavelet_detail_3")
SSA = ("ssa_trend", "ssa_residual")
CROSS = ("relative_strength", "sector_correlation", "market_volatility_annualized", "spy_market_regime")


def _frames(spark, sf) -> dict[str, DataFrame]:
    return {modules.BARS: src.bars(spark, sf), "market": src.market(spark, sf)}


def _causality(spark, sf) -> DataFrame:
    """The registry of symbols has no dates and is no input to disturb."""
    symbols, found = src.registry(spark, sf), causal_registry()
    owner = {c: m.name for m in found.modules.values() for c in m.outputs}
    done = modules.frames_causality(
        _frames(spark, sf), lambda f: found.compute({**f, "registry": symbols}), list(owner)
    )
    return done.withColumn("causal", F.col("violations") == 0)


def _ingested(spark, sf) -> DataFrame:
    ev = spark.read.parquet(f"{sf}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    # Ids follow the time; every eleventh came in an hour late.
    late = F.when(F.col("event_id") % 11 == 0, F.lit(3_600_000_000)).otherwise(F.lit(0))
    rows = ev.select(F.col("event_type").alias("symbol"), (micros - late).alias("date"), "event_id")
    return quality.temporal_alignment(rows, seq_col="event_id")


_SHARE = "SELECT symbol, date, volume, volume / sum(volume) OVER (PARTITION BY date) AS volume_share FROM bars"

ENTRIES: dict[str, Entry] = {
    "module_custom_feature": entry(
        lambda spark, sf: registry().compute(_frames(spark, sf), names=["day_share"]),
        sql(_SHARE, "bars"),
        digits={"volume_share": 9},
    ),
    "module_validation": entry(
        lambda spark, sf: registry().validate(_frames(spark, sf), names=["returns", "day_share"]),
        sql(
            "SELECT 'returns' AS module, 1 AS tier, 'above_minus_one' AS rule, count(*) FILTER (WHERE NOT ret > -1) AS failures FROM base "
            "UNION ALL SELECT 'returns', 1, 'below_a_tenth', count(*) FILTER (WHERE NOT ret < 0.1) FROM base "
            "UNION ALL SELECT 'day_share', 3, 'is_a_share', count(*) FILTER (WHERE NOT volume_share BETWEEN 0 AND 1) FROM share "
            "UNION ALL SELECT 'day_share', 3, 'is_small', count(*) FILTER (WHERE NOT volume_share < 0.2) FROM share",
            "base",
            share=_SHARE,
        ),
        keys=("module", "tier", "rule"),
        digits={"failures": 0},
    ),
    # Tests tell which features must be causal; counts of leaking rows depend on the series, so there is no SQL.
    "module_causality": entry(_causality, keys=("feature", "causal"), digits={"violations": 0}),
    "temporal_alignment_sequence": entry(
        _ingested,
        """WITH ev AS (SELECT event_type AS symbol, event_id, epoch_us(ts) - CASE WHEN event_id % 11 = 0 THEN 3600000000 ELSE 0 END AS date FROM events),
          o AS (SELECT *, coalesce(date < lag(date) OVER (PARTITION BY symbol ORDER BY event_id), false)::INT AS late FROM ev),
          d AS (SELECT symbol, date, count(*) AS n, sum(late) AS late FROM o GROUP BY symbol, date)
          SELECT symbol, sum(n - 1) AS duplicate_dates, sum(late) AS out_of_order FROM d GROUP BY symbol""",
        keys=("symbol",),
        digits=same("duplicate_dates out_of_order", 0),
    ),
}
