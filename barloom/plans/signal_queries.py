"""Registered queries: signal processing, last-bar signals, causality, and the composite pipeline."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.blocks import in_blocks
from barloom.operators import clean, signal, trading
from barloom.operators import features as ft
from barloom.plans.entries import Entry, entry, same
from barloom.plans import cleaning_queries as cq
from barloom.plans.oracle import W, roll, sql
from barloom.plans.oracle import ewm as ewm_sql
from barloom.sources import bars as src


def _on_bars(op):
    return lambda spark, sf: op(src.bars(spark, sf))


Q, R = 1e-5, 1e-3
_KALMAN = {
    "obs": f"SELECT symbol, date, ln(close) AS y, row_number() OVER ({W}) AS n FROM bars",
    "k": f"""SELECT symbol, n, y AS lvl, 0e0 AS z, ({R} + {Q}) * {R} / ({R} + {Q} + {R}) AS p FROM obs WHERE n = 1
      UNION ALL SELECT o.symbol, o.n, k.lvl + (k.p + {Q}) / (k.p + {Q} + {R}) * (o.y - k.lvl), (o.y - k.lvl) / sqrt(k.p + {Q} + {R}), (1 - (k.p + {Q}) / (k.p + {Q} + {R})) * (k.p + {Q})
      FROM k JOIN obs o ON o.symbol = k.symbol AND o.n = k.n + 1""",
}
_TAPS = signal.wavelet_taps()
_BANDS = ("wavelet_approximation", "wavelet_detail_1", "wavelet_detail_2", "wavelet_detail_3")


def _fir(row) -> str:
    return " + ".join(f"{float(row[63 - k])!r}::DOUBLE * lag(y, {k}) OVER ({W})" for k in range(64))


_LAST = {
    "aged": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 AS age, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS older FROM bars",
    "kept": "SELECT *, close - older AS df, (close - older) / older AS rt FROM aged WHERE age < 60",
    "ind0": """SELECT symbol, max(date) AS date, max(close) FILTER (WHERE age = 0) AS close, avg(rt) FILTER (WHERE age < 5) AS returns_5d, avg(rt) FILTER (WHERE age < 20) AS returns_20d, stddev_pop(rt) FILTER (WHERE age < 20) AS volatility,
      avg(greatest(df, 0e0)) FILTER (WHERE age < 14) AS g, avg(greatest(-df, 0e0)) FILTER (WHERE age < 14) AS l,
      sum(close * pow(1 - 2e0 / 13, age)) / sum(pow(1 - 2e0 / 13, age)) - sum(close * pow(1 - 2e0 / 27, age)) / sum(pow(1 - 2e0 / 27, age)) AS macd,
      avg(close) FILTER (WHERE age < 20) AS sma, stddev_pop(close) FILTER (WHERE age < 20) AS sd,
      max(close) FILTER (WHERE age = 0) - max(close) FILTER (WHERE age = 4) AS momentum, max(volume) FILTER (WHERE age = 0) / avg(volume) FILTER (WHERE age < 20) AS volume_ratio FROM kept GROUP BY symbol""",
    "ind": "SELECT *, 100 - 100 / (1 + CASE WHEN l <> 0 THEN g / l ELSE 0 END) AS rsi_14, sma + 2 * sd AS bb_upper, sma - 2 * sd AS bb_lower, (close - (sma - 2 * sd)) / NULLIF((sma + 2 * sd) - (sma - 2 * sd), 0) AS bb_position FROM ind0",
    "scored": """SELECT *, ((((CASE WHEN rsi_14 < 30 THEN 1e0 WHEN rsi_14 > 70 THEN -1e0 WHEN rsi_14 < 50 THEN 3e-1 ELSE -3e-1 END) + (CASE WHEN macd > 0 THEN 5e-1 ELSE -5e-1 END))
      + (CASE WHEN bb_position < 0.2 THEN 8e-1 WHEN bb_position > 0.8 THEN -8e-1 ELSE 0e0 END)) + (CASE WHEN momentum > 0 THEN 4e-1 ELSE -4e-1 END)) + (CASE WHEN volume_ratio > 1.2 THEN 2e-1 ELSE 0e0 END) AS score,
      concat_ws('; ', CASE WHEN rsi_14 < 30 THEN 'RSI oversold' WHEN rsi_14 > 70 THEN 'RSI overbought' WHEN rsi_14 < 50 THEN 'RSI downtrend' ELSE 'RSI uptrend' END, CASE WHEN macd > 0 THEN 'MACD positive' ELSE 'MACD negative' END,
      CASE WHEN bb_position < 0.2 THEN 'Near lower band' WHEN bb_position > 0.8 THEN 'Near upper band' END, CASE WHEN momentum > 0 THEN 'Positive momentum' ELSE 'Negative momentum' END, CASE WHEN volume_ratio > 1.2 THEN 'High volume' END) AS signals FROM ind""",
}

CAUSAL = ("simple_return", "normalized_close", "rsi_14", "macd_histogram", "bb_width", "stoch_d", "adx_value", "obv_ma20", "momentum_60", "market_regime")


def _leaky(df):
    """Every built-in feature, and one that looks a bar ahead."""
    ahead = F.lead("close").over(Window.partitionBy("symbol").orderBy("date"))
    return ft.compute_features(df).withColumn("planted_leak", ahead)


_CLEAN_FEATURES = [ft.returns(), ft.normalized_prices(), ft.rsi(), ft.macd(), ft.bollinger(), ft.stochastic(), ft.atr(), ft.adx(), ft.obv(), ft.momentum(), ft.volatility()]


def cleaned_features(spark, sf):
    """Clean the dirty bars and compute the tier 1 and 2 features, behind one exchange of the bars."""
    cleaned = clean.clean_bars(src.bars_dirty(spark, sf), src.corporate_actions(spark, sf))
    return ft.compute_features(cleaned, _CLEAN_FEATURES, gaps=False)


def _tick_wavelet(spark, sf):
    df = src.ticks(spark, sf).select("symbol", "date", "close")
    return in_blocks(df, signal.wavelet, halo=64, rows_per_block=4096).withColumn("event_time", F.unix_micros("date"))


ENTRIES: dict[str, Entry] = {
    "kalman": entry(
        _on_bars(signal.kalman),
        sql(
            "SELECT o.symbol, o.date, k.lvl AS kalman_level, k.z AS kalman_innovation_zscore, k.p AS kalman_variance FROM k JOIN obs o ON o.symbol = k.symbol AND o.n = k.n",
            "bars",
            **_KALMAN,
        ).replace("WITH ", "WITH RECURSIVE ", 1),
        digits={"kalman_level": 8, "kalman_innovation_zscore": 6, "kalman_variance": 10},
    ),
    "ssa": entry(_on_bars(signal.ssa), digits=same("ssa_trend ssa_residual", 8)),
    "wavelet": entry(
        _on_bars(signal.wavelet),
        sql(
            "SELECT symbol, date, " + ", ".join(f"{_fir(t)} AS {b}" for t, b in zip(_TAPS, _BANDS)) + " FROM obs",
            "bars",
            obs=_KALMAN["obs"],
        ),
        digits=same(_BANDS, 7),
    ),
    "intraday_wavelet": entry(
        _tick_wavelet,
        sql(
            "SELECT symbol, epoch_us(date) AS event_time, " + ", ".join(f"{_fir(t)} AS {b}" for t, b in zip(_TAPS, _BANDS)) + " FROM obs",
            "ticks",
            obs="SELECT symbol, date, ln(close) AS y FROM ticks",
        ),
        keys=("symbol", "event_time"),
        digits=same(_BANDS, 7),
    ),
    "causality_check": entry(
        lambda spark, sf: signal.causality_check(src.bars(spark, sf), _leaky, [*CAUSAL, "planted_leak"]),
        sql(
            "SELECT feature, CASE WHEN feature = 'planted_leak' THEN leaks ELSE 0 END AS violations FROM (SELECT CAST(sum(1 + (n >= 3)::INT + (n >= 4)::INT) AS BIGINT) AS leaks FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol) WHERE n >= 2), "
            "(VALUES " + ", ".join(f"('{c}')" for c in [*CAUSAL, "planted_leak"]) + ") f(feature)",
            "bars",
        ),
        keys=("feature", "violations"),
    ),
    "latest_indicators": entry(
        _on_bars(trading.latest_indicators),
        sql("SELECT * FROM ind", "bars", **_LAST),
        digits={**same("returns_5d returns_20d volatility rsi_14 macd bb_upper bb_lower bb_position volume_ratio"), "close": 8, "momentum": 8},
    ),
    "signal_score": entry(
        lambda spark, sf: trading.signal_score(trading.latest_indicators(src.bars(spark, sf))).withColumn(
            "signals", F.array_join("signals", "; ")
        ),
        sql(
            "SELECT *, greatest(0.55e0, least(0.95e0, 1 / (1 + exp(-score)))) AS confidence, CASE WHEN score > 0.5e0 THEN 'BUY' WHEN score < -0.5e0 THEN 'SELL' ELSE 'HOLD' END AS recommendation, close * (1 + returns_5d) AS predicted_price FROM scored",
            "bars",
            **_LAST,
        ),
        keys=("symbol", "date", "recommendation", "signals"),
        digits=same("score confidence predicted_price"),
    ),
    "cleaned_features": entry(
        cleaned_features,
        sql(
            "SELECT x.symbol, x.date, ret AS simple_return, CASE WHEN close > 0 AND prev > 0 THEN ln(close / prev) END AS log_return, ma AS close_ma20, sd AS close_std20, (close - ma) / NULLIF(sd, 0) AS normalized_close, "
            "volume / NULLIF(vma, 0) AS normalized_volume, CASE WHEN l.y <= 0 AND g.y > 0 THEN 100 WHEN l.y > 0 THEN 100 - 100 / (1 + g.y / l.y) END AS rsi_14, m.line AS macd_line, s.y AS macd_signal, m.line - s.y AS macd_histogram, "
            "ma AS bb_middle, ma + 2 * sd AS bb_upper, ma - 2 * sd AS bb_lower, 4 * sd AS bb_width, stoch_k, stoch_d, atr_14, adx_plus_di, adx_minus_di, adx_value, obv, obv_ma20, momentum_5, momentum_20, momentum_60, volatility_20 "
            "FROM x LEFT JOIN g USING (symbol, date) LEFT JOIN l USING (symbol, date) LEFT JOIN m USING (symbol, date) LEFT JOIN s USING (symbol, date)",
            "dirty",
            "actions",
            **cq._CLEAN,
            cb=f"SELECT *, lag(close) OVER ({W}) AS prev, close / NULLIF(lag(close) OVER ({W}), 0) - 1 AS ret, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS down FROM adjusted",
            x0=f"SELECT *, {roll('avg', 'close', 20)} AS ma, {roll('stddev_samp', 'close', 20)} AS sd, {roll('avg', 'volume', 20)} AS vma, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr, "
            + "".join(f"close / NULLIF(lag(close, {k}) OVER ({W}), 0) - 1 AS momentum_{k}, " for k in (5, 20, 60))
            + f"{roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pd, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS md, "
            f"sum(coalesce(sign(close - prev) * volume, 0)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS obv, {roll('stddev_samp', 'ret', 20)} AS volatility_20 FROM cb",
            x1=f"SELECT *, {roll('avg', 'tr', 14)} AS atr_14, 100 * (close - lo) / NULLIF(hi - lo, 0) AS stoch_k, {roll('avg', 'obv', 20)} AS obv_ma20, "
            f"100 * ({roll('avg', 'pd', 14)}) / NULLIF({roll('avg', 'tr', 14)}, 0) AS adx_plus_di, 100 * ({roll('avg', 'md', 14)}) / NULLIF({roll('avg', 'tr', 14)}, 0) AS adx_minus_di FROM x0",
            x2=f"SELECT *, {roll('avg', 'stoch_k', 3)} AS stoch_d, 100 * abs(adx_plus_di - adx_minus_di) / NULLIF(adx_plus_di + adx_minus_di, 0) AS dx FROM x1",
            x=f"SELECT *, {roll('avg', 'dx', 14)} AS adx_value FROM x2",
            ch="SELECT symbol, date, greatest(close - prev, 0e0) AS gain, greatest(prev - close, 0e0) AS loss FROM cb WHERE prev IS NOT NULL AND close IS NOT NULL",
            g=ewm_sql("ch", "gain", 14),
            l=ewm_sql("ch", "loss", 14),
            f=ewm_sql("adjusted", "close", 12),
            h=ewm_sql("adjusted", "close", 26),
            m="SELECT symbol, date, f.y - h.y AS line FROM f JOIN h USING (symbol, date)",
            s=ewm_sql("m", "line", 9),
        ),
        digits={
            **same("normalized_close normalized_volume rsi_14 macd_line macd_signal macd_histogram close_std20 bb_upper bb_lower bb_width stoch_k stoch_d atr_14 adx_plus_di adx_minus_di adx_value volatility_20", 5),
            **same("simple_return log_return momentum_5 momentum_20 momentum_60 obv", 8),
            **same("close_ma20 bb_middle", 10),
            "obv_ma20": 5,
        },
    ),
}
