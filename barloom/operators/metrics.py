"""Forecast metrics over long prediction rows, and their bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.blocks import carried, in_slices
from barloom.functions.ranks import average_ranks
from barloom.sources.sinks import materialize

BY = ("model", "split")
TINY = 1e-8


def _known(df: DataFrame) -> DataFrame:
    return df.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())


def point_metrics(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Every metric that is a sum: one map-side combined aggregation.

    mape leaves out actuals that are (nearly) zero and is 0 when everything is zero, NULL when
    only the actuals are. sharpe is the mean prediction over its population deviation.
    """
    y, p = F.col("y_true"), F.col("y_pred")
    nonzero = F.abs(y) > TINY
    wide = _known(df).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(p - y)).alias("mae"),
        F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"),
        F.avg(F.when(nonzero, F.abs((p - y) / y))).alias("_mape"),
        F.count_if(~nonzero).alias("zero_actuals_excluded"),
        F.bool_and(F.abs(p) <= TINY).alias("_flat"),
        F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("directional_accuracy"),
        F.avg(p).alias("_mean"),
        F.stddev_pop(p).alias("_sd"),
    )
    mape = F.when(F.col("_mape").isNotNull(), F.col("_mape") * 100.0).when(F.col("_flat"), 0.0)
    return wide.withColumns({"mape": mape, "sharpe_ratio": _sharpe(F.col("_mean"), F.col("_sd"))}).drop(
        "_mape", "_flat", "_mean", "_sd"
    )


def _sharpe(mean: Column, sd: Column) -> Column:
    return F.when(sd > TINY, F.try_divide(mean, sd)).when(F.abs(mean) <= TINY, 0.0)


def information_coefficient(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Spearman correlation of predictions and actuals, NULL when either is constant or n < 2."""
    rows = materialize(_known(df).select(*by, "y_true", "y_pred"), "predictions")
    return _coefficients(rows, by)


def _coefficients(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    ranked = average_ranks(rows, by, {"y_true": "_ra", "y_pred": "_rp"})
    sums = ranked.groupBy(*by).agg(
        F.covar_pop("_ra", "_rp").alias("_c"), F.stddev_pop("_ra").alias("_a"), F.stddev_pop("_rp").alias("_p")
    )
    ic = F.when((F.col("_a") > 0) & (F.col("_p") > 0), F.try_divide(F.col("_c"), F.col("_a") * F.col("_p")))
    return sums.select(*by, ic.alias("information_coefficient"))


def metric_bundle(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """All six metrics per group."""
    rows = materialize(_known(df).select(*by, "y_true", "y_pred"), "predictions")
    return point_metrics(rows, by=by).join(_coefficients(rows, by), list(by), "left")


# Bootstrap

# The 64-bit mixing function used to draw resampling weights.
GAMMA = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
# Cumulative Poisson(1) probabilities: exp(-1) * sum(1 / k!).
_TERMS = np.cumprod(np.concatenate([[1.0], 1.0 / np.arange(1, 20)]))
POISSON_CDF = np.exp(-1.0) * np.cumsum(_TERMS)


def resample_weights(ids: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weight of every (row, draw), a pure function of row id, draw and seed.

    A lost task that runs again draws the same weights, and no task needs to know the row count.
    """
    with np.errstate(over="ignore"):
        base = ids.astype(np.uint64)[:, None] * np.uint64(GAMMA) + np.uint64(seed)
        z = base + (draws.astype(np.uint64)[None, :] + np.uint64(1)) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        z = z ^ (z >> np.uint64(31))
    u = (z >> np.uint64(11)).astype(float) * 2.0**-53
    return np.searchsorted(POISSON_CDF, u, side="right").astype(float)


SUMS = ("w", "abs_err", "sq_err", "ape", "nonzero", "hits", "pred", "pred_sq", "pred_nonzero")


def bootstrap_draws(
    df: DataFrame,
    *,
    by: Sequence[str] = BY,
    id_col: str | None = None,
    n_bootstrap: int = 1000,
    random_state: int = 42,
) -> DataFrame:
    """(group, draw, metrics): the sum metrics of every paired resample.

    Each task weighs its rows for all draws at once and returns one row of sums per group and
    draw, so the shuffle is tasks x groups x draws rows, not rows x draws.
    """
    row_id = F.col(id_col).cast("bigint") if id_col else F.xxhash64("symbol", "date")
    rows = _known(df).select(F.concat_ws("\u0001", *by).alias("_g"), row_id.alias("_id"), "y_true", "y_pred")
    draws = np.arange(n_bootstrap)

    def fold(batches):
        totals: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, part in pdf.groupby("_g", sort=False):
                for at in range(0, len(part), 2048):
                    chunk = part.iloc[at : at + 2048]
                    y, p = chunk["y_true"].to_numpy(float), chunk["y_pred"].to_numpy(float)
                    err = np.abs(p - y)
                    nz = np.abs(y) > TINY
                    ape = np.divide(err, np.abs(y), out=np.zeros_like(err), where=nz)
                    hit = np.sign(y) == np.sign(p)
                    cells = np.column_stack([np.ones_like(y), err, err**2, ape, nz, hit, p, p**2, np.abs(p) > TINY])
                    w = resample_weights(chunk["_id"].to_numpy(np.int64), draws, random_state)
                    totals[name] = totals.get(name, 0.0) + w.T @ cells.astype(float)
        for name, t in totals.items():
            out = pd.DataFrame(t, columns=list(SUMS))
            out.insert(0, "draw", draws)
            out.insert(0, "_g", name)
            yield out

    schema = "_g STRING, draw INT, " + ", ".join(f"{c} DOUBLE" for c in SUMS)
    s = rows.mapInPandas(fold, schema).groupBy("_g", "draw").agg(*[F.sum(c).alias(c) for c in SUMS]).where("w > 0")
    parts = F.split("_g", "\u0001")
    mean = F.col("pred") / F.col("w")
    sd = F.sqrt(F.greatest(F.col("pred_sq") / F.col("w") - mean * mean, F.lit(0.0)))
    mape = F.when(F.col("nonzero") > 0, 100.0 * F.try_divide(F.col("ape"), F.col("nonzero"))).when(
        F.col("pred_nonzero") == 0, 0.0
    )
    return s.select(
        *[parts[i].alias(c) for i, c in enumerate(by)],
        "draw",
        (F.col("abs_err") / F.col("w")).alias("mae"),
        F.sqrt(F.col("sq_err") / F.col("w")).alias("rmse"),
        mape.alias("mape"),
        (F.col("hits") / F.col("w")).alias("directional_accuracy"),
        _sharpe(mean, sd).alias("sharpe_ratio"),
    )


@dataclass(frozen=True)
class SumMetric:
    """A metric of one's own: row terms (columns of y_true and y_pred), and its value from their means."""

    name: str
    terms: Mapping[str, Column]
    value: Callable[[Mapping[str, Column]], Column]


def bootstrap_metric(
    df: DataFrame,
    metric: SumMetric,
    *,
    by: Sequence[str] = BY,
    id_col: str | None = None,
    n_bootstrap: int = 1000,
    confidence_level: float = 0.95,
    random_state: int = 42,
) -> DataFrame:
    """(group, metric, value, ci_lower, ci_upper, draws) of a given metric over paired resamples.

    Tasks weigh their rows for all draws at once and return one row of sums per group and draw, as for the built-in
    metrics.
    """
    row_id = F.col(id_col).cast("bigint") if id_col else F.xxhash64("symbol", "date")
    names = list(metric.terms)
    cells = F.array(*[c.cast("double") for c in metric.terms.values()])
    rows = _known(df).select(F.concat_ws("\u0001", *by).alias("_g"), row_id.alias("_id"), cells.alias("_t"))
    # Draw -1 weighs every row once: the value itself.
    draws = np.arange(n_bootstrap)

    def fold(batches):
        totals: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, part in pdf.groupby("_g", sort=False):
                for at in range(0, len(part), 2048):
                    chunk = part.iloc[at : at + 2048]
                    terms = np.column_stack([np.ones(len(chunk)), np.stack(chunk["_t"].to_numpy())])
                    w = resample_weights(chunk["_id"].to_numpy(np.int64), draws, random_state)
                    both = np.vstack([w.T @ terms, terms.sum(axis=0)])
                    totals[name] = totals.get(name, 0.0) + both
        for name, t in totals.items():
            out = pd.DataFrame(t, columns=["w", *names])
            out.insert(0, "draw", np.append(draws, -1))
            out.insert(0, "_g", name)
            yield out

    schema = "_g STRING, draw INT, w DOUBLE, " + ", ".join(f"`{c}` DOUBLE" for c in names)
    sums = rows.mapInPandas(fold, schema).groupBy("_g", "draw").agg(*[F.sum(c).alias(c) for c in ("w", *names)]).where("w > 0")
    parts = F.split("_g", "\u0001")
    scored = sums.select(
        *[parts[i].alias(c) for i, c in enumerate(by)], "draw", metric.value({c: F.col(c) / F.col("w") for c in names}).alias("v")
    )
    tail = (1.0 - confidence_level) / 2.0
    drawn = F.when(F.col("draw") >= 0, F.col("v"))
    return scored.groupBy(*by).agg(
        F.max(F.when(F.col("draw") < 0, F.col("v"))).alias("value"),
        F.percentile(drawn, F.lit(tail)).alias("ci_lower"),
        F.percentile(drawn, F.lit(1.0 - tail)).alias("ci_upper"),
        F.count(drawn).alias("draws"),
    ).withColumn("metric", F.lit(metric.name))


INTERVALS = ("mae", "rmse", "mape", "directional_accuracy", "sharpe_ratio")


def interval(draws: DataFrame, names: Sequence[str], *, by: Sequence[str], confidence_level: float) -> DataFrame:
    """Percentile interval of each metric over its draws; undefined draws do not count."""
    tail = (1.0 - confidence_level) / 2.0
    wide = draws.groupBy(*by).agg(
        *[F.percentile(c, [tail, 1.0 - tail]).alias(f"{c}_q") for c in names], *[F.count(c).alias(f"{c}_n") for c in names]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("metric"),
                F.col(f"{c}_q")[0].alias("ci_lower"),
                F.col(f"{c}_q")[1].alias("ci_upper"),
                F.col(f"{c}_n").alias("draws"),
            )
            for c in names
        ]
    )
    return wide.select(*by, F.inline(cells))


def bootstrap_ci(
    df: DataFrame,
    *,
    by: Sequence[str] = BY,
    id_col: str | None = None,
    n_bootstrap: int = 1000,
    confidence_level: float = 0.95,
    random_state: int = 42,
) -> DataFrame:
    """(group, metric, value, ci_lower, ci_upper) for the five sum metrics."""
    if n_bootstrap < 1 or not 0 < confidence_level < 1:
        raise ValueError("n_bootstrap must be positive and confidence_level between 0 and 1")
    ids = [id_col] if id_col else ["symbol", "date"]
    df = materialize(_known(df).select(*dict.fromkeys([*by, *ids, "y_true", "y_pred"])), "predictions")
    draws = bootstrap_draws(df, by=by, id_col=id_col, n_bootstrap=n_bootstrap, random_state=random_state)
    bounds = interval(draws, INTERVALS, by=by, confidence_level=confidence_level)
    point = point_metrics(df, by=by)
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in INTERVALS])
    return point.select(*by, F.inline(cells)).join(bounds, [*by, "metric"], "left")


#: Rows whose weights for all draws are in memory at a time.
ROWS_PER_SLICE = 1024


def _runs(values: np.ndarray) -> np.ndarray:
    """The number of its run of equal values for each of sorted values."""
    return np.concatenate([[0], np.cumsum(values[1:] != values[:-1])])


def _slice_vectors(rows: DataFrame, value: str, weigh: Callable[[np.ndarray], np.ndarray], slice_col: str) -> DataFrame:
    """(_g, slice, before, ties_before, ties): for each slice of rows in the order of ``value`` vectors over the draws.

    ``before`` is the weight of earlier slices; ``ties_before`` and ``ties`` hold, for the first and the last value of the
    slice, the weight of that value in earlier slices and in all of them. A slice returns its total and those of its two
    outer runs, one row per draw; all else are sums over slices.
    """

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf[value].to_numpy(float))
        pdf = pdf.iloc[np.argsort(pdf[value].to_numpy(float), kind="stable")]
        w = weigh(pdf["_id"].to_numpy(np.int64))
        head, tail = w[v == v[0]].sum(axis=0), w[v == v[-1]].sum(axis=0)
        return pd.DataFrame(
            {"_g": pdf["_g"].iloc[0], "_slice": pdf[slice_col].iloc[0], "draw": np.arange(w.shape[1]), "total": w.sum(axis=0),
             "v0": v[0], "w0": head, "v1": v[-1], "w1": tail}
        )

    schema = "_g STRING, _slice BIGINT, draw INT, total DOUBLE, v0 DOUBLE, w0 DOUBLE, v1 DOUBLE, w1 DOUBLE"
    sums = rows.select("_g", slice_col, value, "_id").groupBy("_g", slice_col).applyInPandas(summary, schema)
    sums = materialize(sums.withColumn("_k", F.concat_ws("\u0001", "_g", "draw")), "slice-weights")
    before = carried(sums.select("_k", "_slice", "total"), "total", "before", symbol_col="_k")
    outer = F.array_distinct(F.array(F.struct(F.col("v0").alias("v"), F.col("w0").alias("w")), F.struct(F.col("v1").alias("v"), F.col("w1").alias("w"))))
    runs = sums.select("_k", "_slice", F.inline(outer)).withColumn("_kv", F.concat_ws("\u0001", "_k", F.col("v").cast("string")))
    runs = materialize(runs, "outer-runs")
    ahead = carried(runs.select("_kv", "_slice", "w"), "w", "ties_before", symbol_col="_kv")
    whole = runs.groupBy("_kv").agg(F.sum("w").alias("ties"))
    runs = runs.join(ahead, ["_kv", "_slice"]).join(whole, "_kv").select("_k", "_slice", "v", "ties_before", "ties")
    each = sums.select("_g", "draw", "_k", "_slice", "v0", "v1").join(before, ["_k", "_slice"])
    for k in "01":
        side = runs.select("_k", "_slice", F.col("v").alias(f"v{k}"), F.col("ties_before").alias(f"b{k}"), F.col("ties").alias(f"t{k}"))
        each = each.join(side, ["_k", "_slice", f"v{k}"])
    vectors = F.array_sort(F.collect_list(F.struct("draw", "before", "b0", "t0", "b1", "t1")))
    packed = each.groupBy("_g", "_slice").agg(vectors.alias("x"))
    return packed.select("_g", F.col("_slice").alias(slice_col), *[F.col(f"x.{c}").alias(c) for c in ("before", "b0", "t0", "b1", "t1")])


def _mid_ranks(values: np.ndarray, w: np.ndarray, vectors: pd.Series) -> np.ndarray:
    """Weighted mid-ranks (rows x draws) of a slice's sorted values."""
    run = _runs(values)
    first = np.flatnonzero(np.diff(run, prepend=-1))
    here = np.add.reduceat(w, first, axis=0)
    below = np.cumsum(here, axis=0) - here + np.asarray(vectors["before"])
    ahead, ties = np.zeros_like(here), here.copy()
    ahead[0], ties[0] = vectors["b0"], vectors["t0"]
    ahead[-1], ties[-1] = vectors["b1"], vectors["t1"]
    return (below - ahead + (ties + 1) / 2.0)[run]


def _ic_draws(df: DataFrame, *, by: Sequence[str], id_col: str | None, n_bootstrap: int, random_state: int) -> DataFrame:
    """(group, draw, information_coefficient) of every paired resample.

    Rows lie in slices of their order by prediction and, later, by actual. A slice weighs its rows for all draws and ranks
    them with the weights of other slices, which are vectors over the draws. A row takes its ranks among the actuals, one
    vector, to its slice of predictions; slices return sums over their rows.
    """
    row_id = F.col(id_col).cast("bigint") if id_col else F.xxhash64("symbol", "date")
    rows = _known(df).select(F.concat_ws("\u0001", *by).alias("_g"), row_id.alias("_id"), *[(F.col(c).cast("double") + 0.0).alias(c) for c in ("y_true", "y_pred")])
    draws = np.arange(n_bootstrap)

    def weigh(ids: np.ndarray) -> np.ndarray:
        return resample_weights(ids, draws, random_state)

    def laid(rows: DataFrame, value: str, slice_col: str) -> DataFrame:
        return in_slices(rows, symbol_col="_g", order_col=value, rows_per_slice=ROWS_PER_SLICE).withColumnRenamed("_slice", slice_col).drop("_at")

    rows = laid(laid(rows, "y_pred", "_p"), "y_true", "_a")
    actual = _slice_vectors(rows, "y_true", weigh, "_a")
    predicted = _slice_vectors(rows, "y_pred", weigh, "_p")

    def rank_actuals(pdf: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y_true")
        ranks = _mid_ranks(pdf["y_true"].to_numpy(float), weigh(pdf["_id"].to_numpy(np.int64)), vectors.iloc[0])
        return pdf[["_g", "_p", "_id", "y_pred"]].assign(ranks=[r.tobytes() for r in ranks])

    def sums(pdf: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y_pred")
        w = weigh(pdf["_id"].to_numpy(np.int64))
        a = np.stack([np.frombuffer(r) for r in pdf["ranks"]])
        p = _mid_ranks(pdf["y_pred"].to_numpy(float), w, vectors.iloc[0])
        cells = {"n": w, "sa": w * a, "sp": w * p, "saa": w * a * a, "spp": w * p * p, "sap": w * a * p}
        return pd.DataFrame({"_g": pdf["_g"].iloc[0], "draw": draws} | {c: x.sum(axis=0) for c, x in cells.items()})

    met = rows.groupBy("_g", "_a").cogroup(actual.groupBy("_g", "_a")).applyInPandas(rank_actuals, "_g STRING, _p BIGINT, _id BIGINT, y_pred DOUBLE, ranks BINARY")
    names = ("n", "sa", "sp", "saa", "spp", "sap")
    parts = met.groupBy("_g", "_p").cogroup(predicted.groupBy("_g", "_p")).applyInPandas(sums, "_g STRING, draw INT, " + ", ".join(f"{c} DOUBLE" for c in names))
    s = parts.groupBy("_g", "draw").agg(*[F.sum(c).alias(c) for c in names]).where("n > 0")

    def spread(both: str, one: str, other: str) -> Column:
        return F.col(both) / F.col("n") - F.col(one) * F.col(other) / (F.col("n") * F.col("n"))

    va, vp = spread("saa", "sa", "sa"), spread("spp", "sp", "sp")
    ic = F.when((va > TINY) & (vp > TINY), F.try_divide(spread("sap", "sa", "sp"), F.sqrt(va * vp)))
    key = F.split("_g", "\u0001")
    return s.select(*[key[i].alias(c) for i, c in enumerate(by)], "draw", ic.alias("information_coefficient"))


def bootstrap_ic(
    df: DataFrame,
    *,
    by: Sequence[str] = BY,
    id_col: str | None = None,
    n_bootstrap: int = 1000,
    confidence_level: float = 0.95,
    random_state: int = 42,
) -> DataFrame:
    """Interval of the information coefficient: every resample has ranks of its own.

    A row carries one vector over the draws through one shuffle; it never becomes a row per draw.
    """
    ics = _ic_draws(df, by=by, id_col=id_col, n_bootstrap=n_bootstrap, random_state=random_state)
    return interval(ics, ["information_coefficient"], by=by, confidence_level=confidence_level)
