"""State-space, subspace and filter-bank features of the log close, and the causality harness."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.recurrence import Term, linear_recurrence
from barloom.functions.rolling import series_window, trailing


def log_close() -> Column:
    return F.when(F.col("close") > 0, F.ln("close"))


def filtered_variance(n: Column, process_variance: float, measurement_variance: float) -> Column:
    """Variance of the level after ``n`` updates (measurement_variance at 0).

    One update is a fractional linear map with two fixed points; the ratio of the distances to them shrinks by the
    same factor each time.
    """
    q, r = process_variance, measurement_variance
    high = (math.sqrt(q * q + 4.0 * q * r) - q) / 2.0
    low = -(q + high)
    rate = math.log1p(-(high - low) / (r - low))
    ratio = F.exp((n + 1.0) * rate)
    return (high - ratio * low) / -F.expm1((n + 1.0) * rate)


def steady_gain(process_variance: float, measurement_variance: float) -> float:
    """The gain that the filter settles at."""
    q, r = process_variance, measurement_variance
    predicted = (math.sqrt(q * q + 4.0 * q * r) + q) / 2.0
    return predicted / (predicted + r)


def kalman(df: DataFrame, *, process_variance: float = 1e-5, measurement_variance: float = 1e-3) -> DataFrame:
    """Local-level filter of the log close: level, standardised innovation, variance.

    With known gains the level is a linear recurrence, so it runs as window sums.
    """
    if process_variance < 0 or measurement_variance <= 0:
        raise ValueError("process_variance must be >= 0 and measurement_variance > 0")
    w = series_window()
    df = df.withColumns({"_row": F.row_number().over(w), "_y": log_close()})
    if process_variance == 0:
        # gain 1 / (n + 1), variance R / (n + 1)
        n = F.col("_row").cast("double")
        gain = 1.0 / (n + 1.0)
        spread = measurement_variance * (1.0 / n + 1.0)
        variance = measurement_variance / (n + 1.0)
        unit = 0.0
    else:
        n = F.col("_row").cast("double")
        predicted = filtered_variance(n - 1.0, process_variance, measurement_variance) + process_variance
        spread = predicted + measurement_variance
        gain = predicted / spread
        variance = filtered_variance(n, process_variance, measurement_variance)
        unit = -math.log1p(-steady_gain(process_variance, measurement_variance))
    df = df.withColumns({"_gain": gain, "_spread": spread, "kalman_variance": variance})
    # The first row starts the level at its own observation.
    extra = F.when(F.col("_row") > 1, -F.log1p(-F.col("_gain")) - unit)
    df = df.withColumns(
        {
            "_push": F.when(F.col("_row") == 1, F.col("_y")).otherwise(F.col("_gain") * F.col("_y")),
            "_extra": extra,
        }
    )
    df = linear_recurrence(df, [Term("kalman_level", unit, "_push", "_extra")])
    before = F.coalesce(F.lag("kalman_level").over(w), F.col("_y"))
    return df.withColumn("kalman_innovation_zscore", (F.col("_y") - before) / F.sqrt("_spread")).drop(
        "_row", "_y", "_gain", "_spread", "_push", "_extra"
    )


def ssa(df: DataFrame, *, window: int = 40, embedding_dimension: int = 10) -> DataFrame:
    """End point of the rank-1 reconstruction of the last ``window`` log closes, and what it leaves.

    The window frame hands each row its own values; the decomposition of many rows is one
    batched call per Arrow batch.
    """
    rows, columns = embedding_dimension, window - embedding_dimension + 1
    if window < 3 or not 2 <= rows < window:
        raise ValueError("window must be >= 3 and embedding_dimension in [2, window - 1]")

    @F.pandas_udf("double")
    def endpoint(segments: pd.Series) -> pd.Series:
        out = np.full(len(segments), np.nan)
        full = np.array([s is not None for s in segments])
        if full.any():
            x = np.stack(segments[full].to_numpy()).astype(float)
            # lagged[i, j] = x[i + j]: rows are the embedding, columns the positions.
            lagged = np.lib.stride_tricks.sliding_window_view(x, columns, axis=1)[:, :rows]
            # Columns of ``lagged`` transposed give the rows x rows matrix whose leading vector is wanted.
            gram = lagged @ lagged.transpose(0, 2, 1)
            u = np.linalg.eigh(gram)[1][:, :, -1]
            last = np.einsum("nr,nr->n", lagged[:, :, -1], u)
            out[full] = last * u[:, -1]
        return pd.Series(out).where(pd.Series(full), None)

    w = series_window()
    frame = trailing(w, window)
    df = df.withColumn("_y", log_close())
    segment = F.when(F.count("_y").over(frame) == window, F.collect_list("_y").over(frame))
    df = df.withColumn("_segment", segment).withColumn("ssa_trend", endpoint("_segment"))
    return df.withColumn("ssa_residual", F.col("_y") - F.col("ssa_trend")).drop("_y", "_segment")


# Daubechies scaling filter with eight taps.
DB4 = (
    0.2303778133088965,
    0.7148465705529156,
    0.6308807679298589,
    -0.02798376941685985,
    -0.18703481171909309,
    0.03084138183556076,
    0.03288301166688519,
    -0.01059740178506903,
)


def _analyse(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One filter-bank step with half-sample symmetric extension; samples run along axis 0."""
    pad = len(h) - 1
    wide = np.concatenate([x[:pad][::-1], x, x[-pad:][::-1]])
    out = [sum(h[j] * wide[2 * k + 1 - j + pad] for j in range(len(h))) for k in range((len(x) + pad) // 2)]
    return np.array(out)


def _synthesise(a: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Inverse step: spread by two, filter, trim the borders."""
    n, taps = len(a), len(low)
    out = np.zeros((2 * n + taps - 1, *a.shape[1:]))
    for k in range(n):
        for j in range(taps):
            out[2 * k + j] += low[j] * a[k] + high[j] * d[k]
    return out[taps - 2 : 2 * n]


def wavelet_taps(window: int = 64, level: int = 3) -> np.ndarray:
    """Weights that map a window to the last sample of each isolated band.

    Row 0 is the approximation, row i detail i, coarsest first. The decomposition is linear,
    so the weights are its answers to the unit impulses. Computed once, on the driver.
    """
    low = np.array(DB4)
    dec_low = low[::-1]
    dec_high = np.array([(-1.0) ** (k + 1) * low[k] for k in range(len(low))])
    high = dec_high[::-1]
    if level < 1 or level > int(math.log2(window / (len(low) - 1))):
        raise ValueError(f"level {level} is too deep for a window of {window}")
    a, details = np.eye(window), []
    for _ in range(level):
        a, d = _analyse(a, dec_low), _analyse(a, dec_high)
        details.append(d)
    bands = [a, *details[::-1]]
    out = []
    for keep in range(level + 1):
        parts = [b if i == keep else np.zeros_like(b) for i, b in enumerate(bands)]
        x = parts[0]
        for d in parts[1:]:
            x = _synthesise(x[: len(d)], d, low, high)
        out.append(x[window - 1])
    return np.array(out)


def wavelet(df: DataFrame, *, window: int = 64, level: int = 3) -> DataFrame:
    """Last sample of each wavelet band of the trailing log closes: ``window`` lags and a fixed dot product."""
    taps = wavelet_taps(window, level)
    w = series_window()
    df = df.withColumn("_y", log_close())
    df = df.withColumns({f"_y{k}": F.lag("_y", k).over(w) for k in range(window)})
    names = ["wavelet_approximation", *[f"wavelet_detail_{i}" for i in range(1, level + 1)]]
    out = {}
    for name, row in zip(names, taps):
        total = F.lit(0.0)
        for k in range(window):
            total = total + F.col(f"_y{k}") * F.lit(float(row[window - 1 - k]))
        out[name] = total
    return df.withColumns(out).drop("_y", *[f"_y{k}" for k in range(window)])


NUMERIC = ("open", "high", "low", "close", "volume")


def causality_check(
    df: DataFrame,
    op: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    *,
    check_points: int = 3,
    tolerance: float = 1e-10,
) -> DataFrame:
    """(feature, violations): rows up to a cut-off that change when the rows after it are multiplied by 1.137.

    The untouched series and its disturbed copies run through ``op`` together, as separate
    symbols, and are compared by one aggregation on (symbol, date).
    """
    numeric = [c for c in NUMERIC if c in df.columns]
    w = series_window()
    rows = df.withColumns({"_probe_at": F.row_number().over(w) - 1, "_probe_len": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    share = [i / max(check_points - 1, 1) for i in range(check_points)]
    cuts = F.array(*[F.floor((F.col("_probe_len") - 2) * F.lit(s)) for s in share])
    cuts = F.array_distinct(F.filter(cuts, lambda c: c >= 0))
    rows = rows.withColumn("_probe_cut", F.explode(F.concat(F.array(F.lit(-1).cast("bigint")), cuts)))
    after = (F.col("_probe_cut") >= 0) & (F.col("_probe_at") > F.col("_probe_cut"))
    rows = rows.withColumns({c: F.when(after, F.col(c) * 1.137).otherwise(F.col(c)) for c in numeric})
    rows = rows.withColumns(
        {"_probe_symbol": F.col("symbol"), "symbol": F.concat_ws("\u0001", "symbol", F.col("_probe_cut").cast("string"))}
    )
    done = op(rows).where((F.col("_probe_cut") < 0) | (F.col("_probe_at") <= F.col("_probe_cut")))
    base = {c: F.max(F.when(F.col("_probe_cut") < 0, F.col(c).cast("double"))).alias(f"_b_{c}") for c in features}
    seen = {
        c: F.collect_list(F.when(F.col("_probe_cut") >= 0, F.struct(F.col(c).cast("double").alias("v")))).alias(f"_v_{c}")
        for c in features
    }
    keyed = done.groupBy("_probe_symbol", "date").agg(*base.values(), *seen.values())

    def differs(c: str) -> Column:
        b = F.col(f"_b_{c}")
        return F.size(
            F.filter(
                f"_v_{c}",
                lambda s: ~(
                    (s["v"].isNull() & b.isNull())
                    | F.coalesce(F.abs(s["v"] - b) <= tolerance + tolerance * F.abs(b), F.lit(False))
                ),
            )
        )

    wide = keyed.agg(*[F.sum(differs(c)).alias(f"{c}") for c in features])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("violations")) for c in features])
    return wide.select(F.inline(cells))
