"""Registered queries: features of one series (tiers 1 to 3) and the exponential mean kernel."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.blocks import in_blocks, running_total
from barloom.functions.recurrence import Ewm, ewm, ewm_halo
from barloom.functions.rolling import series_window
from barloom.operators import features as ft
from barloom.plans.entries import Entry, entry, same
from barloom.plans.oracle import W, roll, sql
from barloom.plans.oracle import ewm as ewm_sql
from barloom.sources import bars as src


def _one(feature: ft.Feature):
    return lambda spark, sf: ft.compute_features(src.bars(spark, sf), [feature])


VOL_THRESHOLD = 0.13


def flagship(spark, sf):
    """Returns, normalised prices, volatility and regime of every symbol in one pass."""
    chosen = [ft.returns(), ft.normalized_prices(), ft.volatility(), ft.market_regime(vol_threshold=VOL_THRESHOLD)]
    return ft.compute_features(src.bars(spark, sf), chosen)


_REGIME = f"""CASE WHEN trend IS NULL OR vol IS NULL THEN NULL WHEN vol > {VOL_THRESHOLD} THEN 3
  WHEN trend > 0.02 THEN 2 WHEN trend < -0.02 THEN 0 ELSE 1 END"""
_NORM = f"""SELECT symbol, date, close, volume, {roll('avg', 'close', 20)} AS close_ma20,
  {roll('stddev_samp', 'close', 20)} AS close_std20, {roll('avg', 'volume', 20)} AS vma FROM bars"""
_TR = "greatest(high - low, abs(high - prev), abs(low - prev))"
_MOVE = f"""SELECT *, {_TR} AS tr, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS down FROM base"""


def _tick_features(spark, sf):
    """The same trailing windows on intraday series, in row blocks."""
    chosen = [ft.returns(), ft.normalized_prices(), ft.momentum()]
    df = src.ticks(spark, sf).select("symbol", "date", "close", "volume")
    return in_blocks(df, lambda d: ft.compute_features(d, chosen), halo=61, rows_per_block=4096)


def _tick_obv(spark, sf):
    def flow(d):
        w = series_window()
        prev = F.lag("close").over(w)
        return d.withColumn("flow", F.coalesce(F.signum(F.col("close") - prev) * F.col("volume"), F.lit(0.0)))

    df = src.ticks(spark, sf).select("symbol", "date", "close", "volume")
    signed = in_blocks(df, flow, halo=1, rows_per_block=4096)
    return running_total(signed, F.col("flow"), "obv", rows_per_slice=4096)


def _tick_ewm(spark, sf):
    df = src.ticks(spark, sf).select("symbol", "date", "close")
    means = [Ewm("ewm_12", "close", 12), Ewm("ewm_26", "close", 26)]
    return in_blocks(df, lambda d: ewm(d, means), halo=ewm_halo(means), rows_per_block=4096)


TS = ("symbol", "event_time")


def _stamped(plan):
    return lambda spark, sf: plan(spark, sf).withColumn("event_time", F.unix_micros("date"))


ENTRIES: dict[str, Entry] = {
    "returns_regime": entry(
        flagship,
        sql(
            f"SELECT symbol, date, simple_return, log_return, close_ma20, close_std20, (close - close_ma20) / NULLIF(close_std20, 0) AS normalized_close, "
            f"volume / NULLIF(vma, 0) AS normalized_volume, vol20 AS volatility_20, {_REGIME} AS market_regime FROM f",
            "base",
            f=f"""SELECT symbol, date, close, volume, ret AS simple_return, ln(close / prev) AS log_return,
              {roll('avg', 'close', 20)} AS close_ma20, {roll('stddev_samp', 'close', 20)} AS close_std20,
              {roll('avg', 'volume', 20)} AS vma, {roll('stddev_samp', 'ret', 20)} AS vol20,
              close / lag(close, 60) OVER ({W}) - 1 AS trend, {roll('stddev_samp', 'ret', 60)} AS vol FROM base""",
        ),
        digits={
            **same("simple_return log_return close_std20 normalized_close normalized_volume volatility_20"),
            "close_ma20": 10,
            "market_regime": 0,
        },
    ),
    "returns": entry(
        _one(ft.returns()),
        sql("SELECT symbol, date, ret AS simple_return, ln(close / prev) AS log_return FROM base", "base"),
        digits=same("simple_return log_return", 8),
    ),
    "normalized_prices": entry(
        _one(ft.normalized_prices()),
        sql(
            "SELECT *, (close - close_ma20) / NULLIF(close_std20, 0) AS normalized_close, "
            "volume / NULLIF(vma, 0) AS normalized_volume FROM n",
            "bars",
            n=_NORM,
        ),
        digits={**same("close_std20 normalized_close normalized_volume"), "close_ma20": 10},
    ),
    "rsi": entry(
        _one(ft.rsi()),
        sql(
            "SELECT b.symbol, b.date, CASE WHEN l.y <= 0 AND g.y > 0 THEN 100 WHEN l.y > 0 THEN "
            "100 - 100 / (1 + g.y / l.y) END AS rsi_14 FROM bars b LEFT JOIN g USING (symbol, date) "
            "LEFT JOIN l USING (symbol, date)",
            "base",
            d="SELECT symbol, date, greatest(close - prev, 0e0) AS gain, greatest(prev - close, 0e0) AS loss "
            "FROM base WHERE prev IS NOT NULL",
            g=ewm_sql("d", "gain", 14),
            l=ewm_sql("d", "loss", 14),
        ),
        digits=same("rsi_14"),
    ),
    "macd": entry(
        _one(ft.macd()),
        sql(
            "SELECT symbol, date, line AS macd_line, y AS macd_signal, line - y AS macd_histogram "
            "FROM m JOIN s USING (symbol, date)",
            "bars",
            f=ewm_sql("bars", "close", 12),
            g=ewm_sql("bars", "close", 26),
            m="SELECT symbol, date, f.y - g.y AS line FROM f JOIN g USING (symbol, date)",
            s=ewm_sql("m", "line", 9),
        ),
        digits=same("macd_line macd_signal macd_histogram", 5),
    ),
    "ewm": entry(
        lambda spark, sf: ewm(
            src.bars(spark, sf).select("symbol", "date", "close"), [Ewm("ewm_10", "close", 10), Ewm("ewm_50", "close", 50)]
        ),
        sql(
            "SELECT symbol, date, f.y AS ewm_10, g.y AS ewm_50 FROM f JOIN g USING (symbol, date)",
            "bars",
            f=ewm_sql("bars", "close", 10),
            g=ewm_sql("bars", "close", 50),
        ),
        digits=same("ewm_10 ewm_50"),
    ),
    "bollinger": entry(
        _one(ft.bollinger()),
        sql(
            "SELECT symbol, date, m AS bb_middle, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower, "
            "(m + 2 * s) - (m - 2 * s) AS bb_width FROM n",
            "bars",
            n=f"SELECT symbol, date, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM bars",
        ),
        digits={**same("bb_upper bb_lower bb_width"), "bb_middle": 10},
    ),
    "stochastic": entry(
        _one(ft.stochastic()),
        sql(
            f"SELECT symbol, date, stoch_k, {roll('avg', 'stoch_k', 3)} AS stoch_d FROM k",
            "bars",
            n=f"SELECT symbol, date, close, {roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi FROM bars",
            k="SELECT symbol, date, 100 * (close - lo) / NULLIF(hi - lo, 0) AS stoch_k FROM n",
        ),
        digits=same("stoch_k stoch_d"),
    ),
    "atr": entry(
        _one(ft.atr()),
        sql(
            f"SELECT symbol, date, {roll('avg', 'tr', 14)} AS atr_14 FROM t",
            "base",
            t=f"SELECT symbol, date, {_TR} AS tr FROM base",
        ),
        digits={"atr_14": 8},
    ),
    "adx": entry(
        _one(ft.adx()),
        sql(
            f"SELECT symbol, date, p AS adx_plus_di, m AS adx_minus_di, {roll('avg', 'dx', 14)} AS adx_value FROM x",
            "base",
            t=_MOVE,
            d="SELECT symbol, date, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pd, "
            "CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS md FROM t",
            i=f"SELECT symbol, date, 100 * ({roll('avg', 'pd', 14)}) / NULLIF({roll('avg', 'tr', 14)}, 0) AS p, "
            f"100 * ({roll('avg', 'md', 14)}) / NULLIF({roll('avg', 'tr', 14)}, 0) AS m FROM d",
            x="SELECT *, 100 * abs(p - m) / NULLIF(p + m, 0) AS dx FROM i",
        ),
        digits=same("adx_plus_di adx_minus_di adx_value"),
    ),
    "obv": entry(
        _one(ft.obv()),
        sql(
            f"SELECT symbol, date, obv, {roll('avg', 'obv', 20)} AS obv_ma20 FROM o",
            "base",
            o=f"SELECT symbol, date, sum(coalesce(sign(close - prev) * volume, 0)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS obv FROM base",
        ),
        digits=same("obv obv_ma20", 8),
    ),
    "momentum": entry(
        _one(ft.momentum()),
        sql(
            "SELECT symbol, date, "
            + ", ".join(f"close / lag(close, {k}) OVER ({W}) - 1 AS momentum_{k}" for k in (5, 20, 60))
            + " FROM bars",
            "bars",
        ),
        digits=same("momentum_5 momentum_20 momentum_60", 8),
    ),
    "volatility": entry(
        _one(ft.volatility()),
        sql(f"SELECT symbol, date, {roll('stddev_samp', 'ret', 20)} AS volatility_20 FROM base", "base"),
        digits=same("volatility_20"),
    ),
    "market_regime": entry(
        _one(ft.market_regime(vol_threshold=VOL_THRESHOLD)),
        sql(
            f"SELECT symbol, date, {_REGIME} AS market_regime FROM r",
            "base",
            r=f"SELECT symbol, date, close / lag(close, 60) OVER ({W}) - 1 AS trend, {roll('stddev_samp', 'ret', 60)} AS vol FROM base",
        ),
        digits={"market_regime": 0},
    ),
    "feature_select": entry(
        lambda spark, sf: ft.select_features(src.bars(spark, sf), enabled=["returns", "stochastic", "momentum"], tiers=[2]),
        sql(
            f"SELECT symbol, date, stoch_k, {roll('avg', 'stoch_k', 3)} AS stoch_d, m5 AS momentum_5, m20 AS momentum_20, m60 AS momentum_60 FROM k",
            "bars",
            n=f"SELECT symbol, date, close, {roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi, "
            + ", ".join(f"close / lag(close, {k}) OVER ({W}) - 1 AS m{k}" for k in (5, 20, 60))
            + " FROM bars",
            k="SELECT *, 100 * (close - lo) / NULLIF(hi - lo, 0) AS stoch_k FROM n",
        ),
        digits=same("stoch_k stoch_d momentum_5 momentum_20 momentum_60"),
    ),
    "intraday_features": entry(
        _stamped(_tick_features),
        sql(
            "SELECT symbol, epoch_us(date) AS event_time, ret AS simple_return, close_ma20, (close - close_ma20) / NULLIF(close_std20, 0) AS normalized_close, momentum_60 FROM n",
            "ticks",
            n=f"SELECT symbol, date, close, close / lag(close) OVER ({W}) - 1 AS ret, {roll('avg', 'close', 20)} AS close_ma20, {roll('stddev_samp', 'close', 20)} AS close_std20, "
            f"close / lag(close, 60) OVER ({W}) - 1 AS momentum_60 FROM ticks",
        ),
        keys=TS,
        digits={**same("simple_return close_ma20 momentum_60", 9), "normalized_close": 6},
    ),
    "intraday_obv": entry(
        _stamped(_tick_obv),
        sql(
            f"SELECT symbol, epoch_us(date) AS event_time, sum(flow) OVER ({W} ROWS UNBOUNDED PRECEDING) AS obv FROM n",
            "ticks",
            n=f"SELECT *, coalesce(sign(close - lag(close) OVER ({W})) * volume, 0) AS flow FROM ticks",
        ),
        keys=TS,
        digits={"obv": 6},
    ),
    "intraday_ewm": entry(
        _stamped(_tick_ewm),
        sql(
            "SELECT symbol, epoch_us(date) AS event_time, f.y AS ewm_12, g.y AS ewm_26 FROM f JOIN g USING (symbol, date)",
            "ticks",
            f=ewm_sql("ticks", "close", 12),
            g=ewm_sql("ticks", "close", 26),
        ),
        keys=TS,
        digits=same("ewm_12 ewm_26"),
    ),
}
