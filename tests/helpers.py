"""Small bar fixtures and brute-force answers written row by row."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

SCHEMA = "symbol STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"


def walk(symbol="AAA", n=300, seed=0, start="2020-01-01", step=0.02):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, step, n)))
    open_ = close * np.exp(rng.normal(0, 0.01, n))
    high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.02, n))
    low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.02, n))
    days = pd.date_range(start, periods=n, freq="D").date
    volume = rng.integers(1_000, 5_000, n).astype(float)
    return pd.DataFrame(dict(symbol=symbol, date=days, open=open_, high=high, low=low, close=close, volume=volume))


def to_spark(spark, pdf, schema=SCHEMA):
    rows = [
        tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False, name=None)
    ]
    return spark.createDataFrame(rows, schema)


def to_pandas(df, by=("symbol", "date")):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def brute_fill(pdf, k=2):
    """Price fill of one symbol, column by column, with row drops in between."""
    pdf = pdf.sort_values("date").reset_index(drop=True)
    for c in ("open", "high", "low", "close"):
        missing = pdf[c].isna().to_numpy()
        drop, i = [], 0
        values = pdf[c].to_numpy().copy()
        while i < len(missing):
            if not missing[i]:
                i += 1
                continue
            j = i
            while j + 1 < len(missing) and missing[j + 1]:
                j += 1
            if j - i + 1 > k:
                drop += list(range(i, j + 1))
            elif i > 0:
                values[i : j + 1] = values[i - 1]
            i = j + 1
        pdf[c] = values
        pdf = pdf.drop(index=drop).reset_index(drop=True)
    return pdf


def brute_volume(pdf):
    v = pdf.sort_values("date")["volume"].to_numpy().copy()
    for i in np.where(np.isnan(v))[0]:
        near = v[max(0, i - 5) : i + 6]
        near = near[~np.isnan(near)]
        if len(near):
            v[i] = np.median(near)
    return v


def brute_spikes(pdf, threshold=0.2):
    """Detect on the closes, confirm, and smooth rejected spikes in date order."""
    pdf = pdf.sort_values("date").reset_index(drop=True)
    raw = pdf.copy()
    ret = raw["close"].pct_change()
    vma = raw["volume"].rolling(20).mean()
    for i in np.where(ret.abs() > threshold)[0]:
        score = int((raw.high[i] - raw.low[i]) / raw.low[i] > abs(ret[i]) * 0.5)
        score += int(len(raw) > 20 and raw.volume[i] / vma[i] > 1.5)
        score += int(abs(ret[i]) > 0.3)
        if score >= 3 or i == 0 or i == len(pdf) - 1:
            continue
        c = (pdf.loc[i - 1, "close"] + pdf.loc[i + 1, "close"]) / 2
        pdf.loc[i, "close"] = c
        pdf.loc[i, "high"] = max(pdf.loc[i, "high"], c)
        pdf.loc[i, "low"] = min(pdf.loc[i, "low"], c)
    return pdf


def ticks(n=2000, seed=3):
    """Two intraday series, one far longer than the other."""
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for symbol, count in (("hot", n), ("cold", n // 20)):
        at = np.sort(rng.choice(86_400 * 20, count, replace=False))
        price = 100 + np.cumsum(rng.normal(0, 0.1, count))
        rows += [(symbol, start + dt.timedelta(seconds=int(s)), float(p), float(rng.integers(1, 9))) for s, p in zip(at, price)]
    return rows
