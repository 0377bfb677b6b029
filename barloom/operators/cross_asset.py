"""Features of a series against the market, its sector and its peers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.guards import broadcast_if_small
from barloom.functions.rolling import ratio, roll, rolling_corr, series_window
from barloom.operators.align import align_asof, align_exact_ffill
from barloom.operators.features import regime_code
from barloom.sources.bars import BENCHMARK, sector_etf
from barloom.sources.registry import first_rows


def _ret(column: str, w) -> Column:
    return ratio(F.col(column), F.lag(column).over(w)) - 1.0


def with_sector(df: DataFrame, registry: DataFrame) -> DataFrame:
    sectors = first_rows(registry).select("symbol", "sector")
    return df.join(broadcast_if_small(sectors), "symbol", "left")


def market_features(
    df: DataFrame,
    market: DataFrame,
    registry: DataFrame,
    *,
    correlation_window: int = 60,
    high_volatility_threshold: float = 0.25,
    regime_column: str = "spy_market_regime",
) -> DataFrame:
    """Add relative strength, sector correlation, and the market's regime and annualised volatility.

    The regime of the market has a name of its own: ``market_regime`` is that of the symbol itself.

    The market series are first put on each symbol's own dates.
    """
    n, w = correlation_window, series_window()
    df = with_sector(df, registry)
    df = align_exact_ffill(df, market, {"_spy": BENCHMARK, "_etf": sector_etf(F.col("sector"))})
    df = df.withColumns(
        {
            "_ret": _ret("close", w),
            "_spy_ret": _ret("_spy", w),
            "_etf_ret": _ret("_etf", w),
            "_trend": ratio(F.col("_spy"), F.lag("_spy", n).over(w)) - 1.0,
        }
    )
    df = df.withColumns(
        {
            "relative_strength": rolling_corr(F.col("_ret"), F.col("_spy_ret"), n, w),
            "sector_correlation": rolling_corr(F.col("_ret"), F.col("_etf_ret"), n, w),
            "market_volatility_annualized": roll(F.stddev_samp, "_spy_ret", n, w) * math.sqrt(252.0),
        }
    )
    regime = regime_code(
        F.col("_trend"),
        F.col("market_volatility_annualized"),
        vol_threshold=high_volatility_threshold,
        return_threshold=0.02,
    )
    return df.withColumn(regime_column, regime).drop("_spy", "_etf", "_ret", "_spy_ret", "_etf_ret", "_trend")


def relative_strength(df: DataFrame, market: DataFrame, *, ticker: str = BENCHMARK, period: int = 60) -> DataFrame:
    """Rolling correlation of returns with one market series, aligned as-of."""
    w = series_window()
    df = align_asof(df, market, ticker, out="_m")
    df = df.withColumns({"_ret": _ret("close", w), "_mret": _ret("_m", w)})
    return df.withColumn("relative_strength", rolling_corr(F.col("_ret"), F.col("_mret"), period, w)).drop(
        "_m", "_ret", "_mret"
    )


# Peers

BUCKETS = 64


def peers_of(targets: DataFrame, registry: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """(symbol, peer): registry symbols of the target's sector and the supplied tickers, without itself.

    Made for a list of target symbols, so the result is the targets times their sector size.
    For every symbol against every peer use :func:`peer_topk`, which never lists the pairs.
    """
    first = first_rows(registry).select(F.upper("symbol").alias("symbol"), "sector")
    wanted = broadcast_if_small(targets.select(F.upper("symbol").alias("symbol")).distinct())
    own = first.join(wanted, "symbol", "left_semi")
    pairs = first.withColumnRenamed("symbol", "peer").join(broadcast_if_small(own), "sector").select("symbol", "peer")
    if supplied is not None:
        # Every target gets every ticker; buckets of tickers spread that over tasks, however many there are.
        listed = supplied.select(F.upper("ticker").alias("peer")).distinct().withColumn("_bucket", F.pmod(F.xxhash64("peer"), F.lit(BUCKETS)))
        spread = own.select("symbol", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BUCKETS - 1).cast("bigint"))).alias("_bucket"))
        pairs = pairs.unionByName(listed.join(spread, "_bucket").select("symbol", "peer"))
    return pairs.where("symbol <> peer").distinct()


def peer_correlations(df: DataFrame, pairs: DataFrame, *, correlation_window: int = 60) -> DataFrame:
    """(symbol, peer, date, correlation) of daily returns for the given pairs."""
    w = Window.partitionBy("symbol", "peer").orderBy("date")
    closes = df.select("symbol", "date", "close")
    peer = closes.select(F.col("symbol").alias("peer"), "date", F.col("close").alias("_pc"))
    rows = closes.join(broadcast_if_small(pairs), "symbol").join(peer, ["peer", "date"], "left")
    rows = rows.withColumn("_pc", F.last("_pc", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"_r": _ret("close", w), "_p": _ret("_pc", w)})
    corr = rolling_corr(F.col("_r"), F.col("_p"), correlation_window, w)
    return rows.withColumn("correlation", corr).drop("_pc", "_r", "_p", "close")


def _window_corr(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Trailing correlation of ``x`` with every column of ``y``; NaN where a pair is missing or flat."""
    out = np.full(y.shape, np.nan)
    view = np.lib.stride_tricks.sliding_window_view
    for at in range(0, len(x) - n + 1, 2048):
        end = min(at + 2048, len(x) - n + 1)
        xs = view(x[at : end + n - 1], n)
        ys = view(y[at : end + n - 1], n, axis=0)
        xd = xs - xs.mean(axis=1, keepdims=True)
        yd = ys - ys.mean(axis=2, keepdims=True)
        cov = np.einsum("tn,tpn->tp", xd, yd)
        spread = np.sqrt((xd**2).sum(axis=1))[:, None] * np.sqrt((yd**2).sum(axis=2))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[at + n - 1 : end + n - 1] = np.where(spread > 0, cov / spread, np.nan)
    return out


def _tile_top(left: pd.DataFrame, right: pd.DataFrame, window: int, top: int, latest: bool = False) -> pd.DataFrame:
    """Best ``top`` peers among the symbols of ``right`` for every bar of ``left``."""
    grid = right.pivot(index="peer_date", columns="peer", values="peer_close").sort_index(axis=1)
    names = grid.columns.to_numpy()
    done = []
    for symbol, own in left.sort_values("date").groupby("symbol", sort=False):
        closes = grid.reindex(own["date"].to_numpy()).ffill().to_numpy(dtype=float)
        with np.errstate(divide="ignore", invalid="ignore"):
            mine = own["close"].to_numpy(dtype=float)
            x = np.concatenate([[np.nan], mine[1:] / mine[:-1] - 1.0])
            y = np.vstack([np.full((1, closes.shape[1]), np.nan), closes[1:] / closes[:-1] - 1.0])
        if latest:
            x, y, own = x[-window:], y[-window:], own.tail(1)
            corr = _window_corr(x, y, window)[-1:]
        else:
            corr = _window_corr(x, y, window)
        corr[:, names == symbol] = np.nan
        rank = np.argsort(np.where(np.isnan(corr), np.inf, -corr), axis=1, kind="stable")[:, :top]
        best = np.take_along_axis(corr, rank, axis=1)
        # One row for each place; the first stays without a peer too, so that no bar is lost.
        flat = pd.DataFrame(
            {
                "symbol": symbol,
                "date": np.repeat(own["date"].to_numpy(), rank.shape[1]),
                "correlation": best.ravel(),
                "peer": names[rank].ravel(),
                "place": np.tile(np.arange(rank.shape[1]), len(rank)),
            }
        )
        done.append(flat[flat["correlation"].notna() | (flat["place"] == 0)][TILE_COLUMNS])
    return pd.concat(done) if done else pd.DataFrame(columns=TILE_COLUMNS)


TILE_COLUMNS = ["symbol", "date", "correlation", "peer"]


def ranked_peers(
    df: DataFrame,
    registry: DataFrame,
    *,
    correlation_window: int = 60,
    top_peers: int = 5,
    tile: int = 64,
    latest: bool = False,
) -> DataFrame:
    """(symbol, date, best): the strongest same-sector correlations of every bar, best first.

    A sector is cut into tiles of about ``tile`` symbols. Each task gets two tiles, whatever
    the sector's size, and returns only its ``top_peers`` per bar; a last aggregation merges
    the tiles. No pair of symbols is ever a row. With ``latest`` only the last bar of each symbol
    is compared (over the whole history, from which missing closes of peers are carried forward).
    """
    rows = with_sector(df.select("symbol", "date", "close"), registry).where(F.col("sector").isNotNull())
    sizes = rows.select("symbol", "sector").distinct().groupBy("sector").agg(
        F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_tiles")
    )
    rows = rows.join(broadcast_if_small(sizes), "sector").withColumn(
        "_tile", F.pmod(F.xxhash64("symbol"), F.col("_tiles"))
    )
    others = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    keys = ["sector", "_i", "_j"]
    left = rows.withColumn("_j", others).withColumnRenamed("_tile", "_i").select(*keys, "symbol", "date", "close")
    right = rows.withColumn("_i", others).select(
        F.col("sector").alias("_sector"),
        F.col("_i").alias("_row"),
        F.col("_tile").alias("_column"),
        F.col("symbol").alias("peer"),
        F.col("date").alias("peer_date"),
        F.col("close").alias("peer_close"),
    )
    per_tile = left.groupBy(*keys).cogroup(right.groupBy("_sector", "_row", "_column")).applyInPandas(
        lambda a, b: _tile_top(a, b, correlation_window, top_peers, latest), "symbol STRING, date DATE, correlation DOUBLE, peer STRING"
    )
    order = lambda a, b: (
        F.when(a["correlation"] > b["correlation"], -1)
        .when(a["correlation"] < b["correlation"], 1)
        .when(a["peer"] < b["peer"], -1)
        .when(a["peer"] > b["peer"], 1)
        .otherwise(0)
    )
    found = F.when(F.col("correlation").isNotNull() & ~F.isnan("correlation"), F.struct("correlation", "peer"))
    merged = F.array_sort(F.collect_list(found), order)
    return per_tile.groupBy("symbol", "date").agg(F.slice(merged, 1, top_peers).alias("best"))


def peer_topk(df: DataFrame, registry: DataFrame, *, top_peers: int = 5, **options) -> DataFrame:
    """k-th strongest peer correlation per bar (NULL where there are fewer), and the mean of them."""
    best = ranked_peers(df, registry, top_peers=top_peers, **options)
    slot = lambda k: F.try_element_at("best", F.lit(k))["correlation"]
    total = F.aggregate("best", F.lit(0.0), lambda acc, p: acc + p["correlation"])
    return best.select(
        "symbol",
        "date",
        *[slot(k).alias(f"sector_peer_corr_top_{k}") for k in range(1, top_peers + 1)],
        ratio(total, F.size("best").cast("double")).alias("sector_peer_corr_top_mean"),
    )


def latest_top_peers(df: DataFrame, registry: DataFrame, **options) -> DataFrame:
    """The strongest peers on the last date of each symbol, best first."""
    best = ranked_peers(df, registry, latest=True, **options)
    last = best.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("best", "date").alias("best"))
    return last.select("symbol", "date", F.posexplode("best").alias("_k", "_p")).select(
        "symbol", "date", (F.col("_k") + 1).alias("rank"), F.col("_p.peer").alias("peer"), "_p.correlation"
    )
