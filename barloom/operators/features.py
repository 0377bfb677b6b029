"""Causal features of one series: tiers 1 to 3.

A feature is a list of stages (name -> Column). Stages of all chosen features are
merged level by level, so features that need the same window share one Window node
and the whole set runs behind a single exchange on ``symbol``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.recurrence import Ewm, ewm
from barloom.functions.rolling import Stage, add_stages, merge_stages, ratio, series_window, trailing, upto


def _prev(column: str, w, k: int = 1) -> Column:
    return F.lag(column, k).over(w)


def _change(w) -> dict[str, Column]:
    """Previous close and simple return, shared by every feature that needs them."""
    prev = _prev("close", w)
    return {"_prev_close": prev, "_ret": ratio(F.col("close"), prev) - 1.0}


_AGGREGATES = {"avg": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}


def _frame_name(kind: str, column: str, n: int) -> str:
    return f"_r_{kind}_{column}_{n}"


def _frames(w, *wanted: tuple[str, str, int]) -> Stage:
    """Trailing aggregates under canonical names, so that features asking for the same one share it."""
    asked = [*wanted, *[("count", column, n) for _, column, n in wanted]]
    return {_frame_name(k, c, n): _AGGREGATES[k](c).over(trailing(w, n)) for k, c, n in asked}


def _framed(kind: str, column: str, n: int) -> Column:
    """The aggregate, NULL until all ``n`` values are present."""
    return F.when(F.col(_frame_name("count", column, n)) == n, F.col(_frame_name(kind, column, n)))


@dataclass(frozen=True)
class Feature:
    """One feature module: its output columns, tier, lookback in rows, and how to compute it."""

    name: str
    tier: int
    outputs: tuple[str, ...]
    lookback: int
    stages: Callable[[object], list[Stage]] = lambda w: []
    means: tuple[Ewm, ...] = ()
    finish: Callable[[object], Stage] = lambda w: {}
    after: Callable[[DataFrame, bool], DataFrame] | None = None
    config: dict = field(default_factory=dict)


def returns() -> Feature:
    def stages(w):
        return [
            _change(w),
            {
                "simple_return": F.col("_ret"),
                "log_return": F.when(
                    (F.col("close") > 0) & (F.col("_prev_close") > 0), F.log(F.col("close") / F.col("_prev_close"))
                ),
            },
        ]

    return Feature("returns", 1, ("simple_return", "log_return"), 1, stages)


def normalized_prices(lookback_window: int = 20) -> Feature:
    n = lookback_window
    ma, std = f"close_ma{n}", f"close_std{n}"

    def stages(w):
        return [
            _frames(w, ("avg", "close", n), ("std", "close", n), ("avg", "volume", n)),
            {
                ma: _framed("avg", "close", n),
                std: _framed("std", "close", n),
                f"_vol_ma{n}": _framed("avg", "volume", n),
            },
            {
                "normalized_close": ratio(F.col("close") - F.col(ma), F.col(std)),
                "normalized_volume": ratio(F.col("volume"), F.col(f"_vol_ma{n}")),
            },
        ]

    return Feature("normalized_prices", 1, (ma, std, "normalized_close", "normalized_volume"), n - 1, stages)


def rsi(period: int = 14) -> Feature:
    """Exponential mean of gains over that of losses, span = period."""
    tag = f"{period}"

    def stages(w):
        diff = F.col("close") - F.col("_prev_close")
        return [
            _change(w),
            {f"_gain{tag}": F.greatest(diff, F.lit(0.0)), f"_loss{tag}": F.greatest(-diff, F.lit(0.0))},
        ]

    # greatest() skips NULL, so the first row needs its own guard.
    def guarded(w):
        first, second = stages(w)
        known = F.col("_prev_close").isNotNull() & F.col("close").isNotNull()
        return [first, {k: F.when(known, v) for k, v in second.items()}]

    def finish(w):
        g, l = F.col(f"_avg_gain{tag}"), F.col(f"_avg_loss{tag}")
        # Rows without a loss so far give 100 when there was a gain, else nothing.
        tiny = l <= 0.0
        value = F.when(tiny & (g > 0.0), F.lit(100.0)).when(~tiny, 100.0 - 100.0 / (1.0 + ratio(g, l)))
        return {f"rsi_{period}": value}

    means = (Ewm(f"_avg_gain{tag}", f"_gain{tag}", period), Ewm(f"_avg_loss{tag}", f"_loss{tag}", period))
    return Feature("rsi", 2, (f"rsi_{period}",), 120 * period, guarded, means, finish)


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Feature:
    means = (Ewm("_ema_fast", "close", fast), Ewm("_ema_slow", "close", slow))

    def finish(w):
        return {"macd_line": F.col("_ema_fast") - F.col("_ema_slow")}

    def after(df, gaps):
        df = ewm(df, [Ewm("macd_signal", "macd_line", signal)], gaps=gaps)
        return df.withColumn("macd_histogram", F.col("macd_line") - F.col("macd_signal"))

    return Feature(
        "macd", 2, ("macd_line", "macd_signal", "macd_histogram"), 60 * slow, means=means, finish=finish, after=after
    )


def bollinger(period: int = 20, num_std: float = 2.0) -> Feature:
    def stages(w):
        return [
            _frames(w, ("avg", "close", period), ("std", "close", period)),
            {"bb_middle": _framed("avg", "close", period), "_bb_std": _framed("std", "close", period)},
            {
                "bb_upper": F.col("bb_middle") + num_std * F.col("_bb_std"),
                "bb_lower": F.col("bb_middle") - num_std * F.col("_bb_std"),
            },
            {"bb_width": F.col("bb_upper") - F.col("bb_lower")},
        ]

    return Feature("bollinger", 2, ("bb_upper", "bb_middle", "bb_lower", "bb_width"), period - 1, stages)


def stochastic(period: int = 14, signal_period: int = 3) -> Feature:
    def stages(w):
        low, high = _framed("min", "low", period), _framed("max", "high", period)
        return [
            _frames(w, ("min", "low", period), ("max", "high", period)),
            {"stoch_k": ratio(100.0 * (F.col("close") - low), high - low)},
            _frames(w, ("avg", "stoch_k", signal_period)),
            {"stoch_d": _framed("avg", "stoch_k", signal_period)},
        ]

    return Feature("stochastic", 2, ("stoch_k", "stoch_d"), period + signal_period - 2, stages)


def _true_range() -> Column:
    prev = F.col("_prev_close")
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )


def atr(period: int = 14) -> Feature:
    def stages(w):
        return [
            _change(w),
            {"_tr": _true_range()},
            _frames(w, ("avg", "_tr", period)),
            {f"atr_{period}": _framed("avg", "_tr", period)},
        ]

    return Feature("atr", 2, (f"atr_{period}",), period, stages)


def adx(period: int = 14) -> Feature:
    def stages(w):
        up = F.col("high") - _prev("high", w)
        down = _prev("low", w) - F.col("low")
        pos = F.when((up > down) & (up > 0), up).otherwise(0.0)
        neg = F.when((down > up) & (down > 0), down).otherwise(0.0)
        a = _framed("avg", "_tr", period)
        plus, minus = F.col("adx_plus_di"), F.col("adx_minus_di")
        return [
            {**_change(w), "_dm_plus": pos, "_dm_minus": neg},
            {"_tr": _true_range()},
            # The moves are never NULL, so the count of the true range guards them as well.
            _frames(w, ("avg", "_tr", period))
            | {_frame_name("avg", c, period): F.avg(c).over(trailing(w, period)) for c in ("_dm_plus", "_dm_minus")},
            {
                "adx_plus_di": ratio(100.0 * F.col(_frame_name("avg", "_dm_plus", period)), a),
                "adx_minus_di": ratio(100.0 * F.col(_frame_name("avg", "_dm_minus", period)), a),
            },
            {"_dx": ratio(100.0 * F.abs(plus - minus), plus + minus)},
            _frames(w, ("avg", "_dx", period)),
            {"adx_value": _framed("avg", "_dx", period)},
        ]

    return Feature("adx", 2, ("adx_plus_di", "adx_minus_di", "adx_value"), 2 * period, stages)


def obv(ma_period: int = 20) -> Feature:
    def stages(w):
        flow = F.signum(F.col("close") - F.col("_prev_close")) * F.col("volume")
        return [
            _change(w),
            {"_flow": F.coalesce(flow, F.lit(0.0))},
            {"obv": F.sum("_flow").over(upto(w))},
            _frames(w, ("avg", "obv", ma_period)),
            {"obv_ma20": _framed("avg", "obv", ma_period)},
        ]

    # The total runs over the whole series: there is no bounded lookback.
    return Feature("obv", 2, ("obv", "obv_ma20"), -1, stages)


def momentum(periods: Sequence[int] = (5, 20, 60)) -> Feature:
    def stages(w):
        return [{f"momentum_{k}": ratio(F.col("close"), _prev("close", w, k)) - 1.0 for k in periods}]

    return Feature("momentum", 2, tuple(f"momentum_{k}" for k in periods), max(periods), stages)


def volatility(period: int = 20) -> Feature:
    def stages(w):
        return [
            _change(w),
            _frames(w, ("std", "_ret", period)),
            {f"volatility_{period}": _framed("std", "_ret", period)},
        ]

    return Feature("volatility", 2, (f"volatility_{period}",), period, stages)


def regime_code(trend: Column, vol: Column, *, vol_threshold: float, return_threshold: float) -> Column:
    """0 bear, 1 sideways, 2 bull, 3 high volatility; NULL until both inputs exist."""
    code = (
        F.when(vol > vol_threshold, 3)
        .when(trend > return_threshold, 2)
        .when(trend < -return_threshold, 0)
        .otherwise(1)
    )
    return F.when(trend.isNotNull() & vol.isNotNull(), code)


def market_regime(lookback: int = 60, vol_threshold: float = 0.05, return_threshold: float = 0.02) -> Feature:
    def stages(w):
        return [
            {**_change(w), "_trend": ratio(F.col("close"), _prev("close", w, lookback)) - 1.0},
            _frames(w, ("std", "_ret", lookback)),
            {
                "market_regime": regime_code(
                    F.col("_trend"),
                    _framed("std", "_ret", lookback),
                    vol_threshold=vol_threshold,
                    return_threshold=return_threshold,
                )
            },
        ]

    return Feature("market_regime", 3, ("market_regime",), lookback, stages)


def default_features() -> dict[str, Feature]:
    """Registry of the built-in single-series features."""
    made = [
        returns(),
        normalized_prices(),
        rsi(),
        macd(),
        bollinger(),
        stochastic(),
        atr(),
        adx(),
        obv(),
        momentum(),
        volatility(),
        market_regime(),
    ]
    return {f.name: f for f in made}


def compute_features(
    df: DataFrame,
    features: Sequence[Feature] | None = None,
    *,
    gaps: bool = True,
    symbol_col: str = "symbol",
    date_col: str = "date",
) -> DataFrame:
    """Add the columns of ``features`` (all built-in ones by default) to the bars.

    Cleaned bars have no missing close after the first known one; for them ``gaps=False``
    spares the recursive features the handling of gaps.
    """
    chosen = list(default_features().values()) if features is None else list(features)
    w = series_window(symbol_col, date_col)
    # Recursive means first, while the rows are narrow; then everything else level by level.
    recursive = [f for f in chosen if f.means]
    if recursive:
        df = add_stages(df, merge_stages(f.stages(w) for f in recursive))
        df = ewm(df, [m for f in recursive for m in f.means], gaps=gaps, symbol_col=symbol_col, date_col=date_col)
        df = add_stages(df, [f.finish(w) for f in recursive])
        for f in recursive:
            if f.after is not None:
                df = f.after(df, gaps)
        df = drop_own_helpers(df)
    df = add_stages(df, merge_stages(f.stages(w) for f in chosen if not f.means))
    return drop_own_helpers(df)


HELPERS = "_prev_close _ret _tr _flow _trend _bb_std _dm_plus _dm_minus _dx _ema_fast _ema_slow".split()


def drop_own_helpers(df: DataFrame) -> DataFrame:
    """Drop the helper columns of this module, leaving those of a caller (block layout) alone."""
    mine = [c for c in df.columns if c in HELPERS or c.startswith(("_r_", "_vol_ma", "_gain", "_loss", "_avg_"))]
    return df.drop(*mine)


def select_features(
    df: DataFrame,
    *,
    registry: dict[str, Feature] | None = None,
    enabled: Sequence[str] | None = None,
    tiers: Sequence[int] | None = None,
    keys: Sequence[str] = ("symbol", "date"),
) -> DataFrame:
    """Compute and project only the features enabled by name or tier."""
    registry = default_features() if registry is None else registry
    chosen = [
        f
        for f in registry.values()
        if (enabled is None or f.name in enabled) and (tiers is None or f.tier in tiers)
    ]
    if not chosen:
        return df.select(*keys)
    outputs = [c for f in chosen for c in f.outputs]
    return compute_features(df, chosen).select(*keys, *outputs)
