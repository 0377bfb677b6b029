"""Forecast baselines: fit on train rows, predict validation and test.

Predictions are long rows (model, split, symbol, date, y_true, y_pred).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.linalg import MomentTable, least_squares, moments, squared_error, total_variation
from barloom.operators import metrics
from barloom.sources.sinks import materialize

KEYS = ("split", "symbol", "date")
ALPHAS = tuple(float(a) for a in np.logspace(-3, 3, 50))


def _as_predictions(df: DataFrame, model: str, y_pred: Column, target: str) -> DataFrame:
    return df.where(F.col("split").isin("validation", "test")).select(
        F.lit(model).alias("model"), *KEYS, F.col(target).alias("y_true"), y_pred.alias("y_pred")
    )


def random_walk(df: DataFrame, *, target: str = "target") -> DataFrame:
    """The last known target of the symbol, across split borders."""
    prev = F.lag(target).over(Window.partitionBy("symbol").orderBy("date"))
    return _as_predictions(df.withColumn("_prev", prev), "random_walk", F.col("_prev"), target)


def historical_mean(df: DataFrame, *, target: str = "target") -> DataFrame:
    """The mean training target."""
    mean = df.where("split = 'train'").agg(F.avg(target)).first()[0]
    return _as_predictions(df, "historical_mean", F.lit(mean).cast("double"), target)


@dataclass(frozen=True)
class LinearModel:
    """Fitted linear model; ``predict`` is one projection."""

    name: str
    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    hyperparameters: dict

    def expression(self) -> Column:
        total = F.lit(self.intercept)
        for c, w in zip(self.features, self.coefficients):
            total = total + F.col(c) * F.lit(w)
        return total

    def predict(self, df: DataFrame, *, target: str = "target") -> DataFrame:
        return _as_predictions(df, self.name, self.expression(), target)

    def table(self, spark: SparkSession) -> DataFrame:
        """(feature, coefficient), the intercept included."""
        rows = [("intercept", self.intercept), *zip(self.features, self.coefficients)]
        return spark.createDataFrame([(n, float(v)) for n, v in rows], "feature STRING, coefficient DOUBLE")


def _narrow(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """The columns a fit reads, written once: a fit passes over them more than once."""
    return materialize(df.select("split", "date", *features, target), "fit-rows")


def fit_linear(
    df: DataFrame, features: Sequence[str], *, target: str = "target", written: bool = False
) -> LinearModel:
    """Ordinary least squares with intercept on the training rows (``written``: ``df`` is a stored table)."""
    df = df if written else _narrow(df, features, target)
    table = moments(df.where("split = 'train'"), features, target, "split")
    intercept, coef = least_squares(table, table.groups["train"])
    return LinearModel("linear_regression", tuple(features), intercept, tuple(float(c) for c in coef), {})


def _folded(df: DataFrame, cv: int) -> DataFrame:
    """Training rows in ``cv`` contiguous folds of equal numbers of dates, validation rows as 'validation'.

    The fold borders are quantiles of the training calendar, one array of days.
    """
    train = df.where("split = 'train'")
    days = train.agg(F.lit(0).alias("_one"), F.array_sort(F.collect_set("date")).alias("_days"))
    ranked = days.select("_one", F.posexplode("_days").alias("_i", "_day"), F.size("_days").alias("_n"))
    # The first n % cv folds are one date longer.
    short, longer = F.floor(F.col("_n") / cv), F.col("_n") % cv
    edge = longer * (short + 1)
    fold = F.when(F.col("_i") < edge, F.floor(F.col("_i") / (short + 1))).otherwise(
        longer + F.floor((F.col("_i") - edge) / F.greatest(short, F.lit(1)))
    )
    marks = ranked.select(F.col("_day").alias("date"), fold.cast("string").alias("_fold"))
    folded = train.join(F.broadcast(marks), "date")
    rest = df.where("split = 'validation'").withColumn("_fold", F.lit("validation"))
    return folded.unionByName(rest)


def fit_ridge(
    df: DataFrame,
    features: Sequence[str],
    *,
    target: str = "target",
    alphas: Sequence[float] = ALPHAS,
    cv: int = 5,
    tune_on_validation: bool = True,
    written: bool = False,
) -> LinearModel:
    """Ridge on standardised features; alpha by validation error (and, reported, by cross-validated R2).

    Folds and validation rows are groups of one moment pass; every fit is a small solve.
    """
    if len(alphas) == 0 or min(alphas) <= 0 or cv < 2:
        raise ValueError("alphas must be positive and cv at least 2")
    df = df if written else _narrow(df, features, target)
    table = moments(_folded(df, cv), features, target, "_fold")
    folds = [m for g, m in table.groups.items() if g != "validation"]
    train = sum(folds[1:], folds[0])
    scale = _train_scale(table, train.matrix)

    def r2(alpha: float) -> float:
        scores = []
        for held in folds:
            fit = least_squares(table, train - held, alpha=alpha, scale=scale)
            spread = total_variation(held, table)
            if spread > 0:
                scores.append(1.0 - squared_error(table, held, *fit) / spread)
        return float(np.mean(scores)) if scores else -np.inf

    cv_alpha = max(alphas, key=r2)
    best, tuned = cv_alpha, "train_cv"
    validation = table.groups.get("validation")
    if tune_on_validation and validation is not None and validation.n > 0:
        error = lambda a: squared_error(table, validation, *least_squares(table, train, alpha=a, scale=scale))
        best, tuned = min(alphas, key=error), "validation"
    intercept, coef = least_squares(table, train, alpha=best, scale=scale)
    found = {"best_alpha": float(best), "cv_best_alpha": float(cv_alpha), "tuning_split": tuned, "cv": cv}
    return LinearModel("ridge_regression", tuple(features), intercept, tuple(float(c) for c in coef), found)


def _train_scale(table: MomentTable, a: np.ndarray) -> np.ndarray:
    """Population deviation of each feature over the training rows, in units of ``spread``."""
    p = len(table.features)
    mean = a[0, 1 : p + 1] / a[0, 0]
    var = np.diag(a)[1 : p + 1] / a[0, 0] - mean**2
    sd = np.sqrt(np.maximum(var, 0.0))
    return np.where(sd > 0, sd, 1.0)


#: Starting points of an ARMA fit: a grid over both parameters, which stay within +-EDGE.
GRID = np.linspace(-0.9, 0.9, 9)
EDGE = 0.99


def css_grid(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Conditional sums of squares of ARMA(1,1) fits on ``w``; all points go through the recursion as one vector."""
    prev = np.concatenate([[0.0], w[:-1]])
    shock = w[:, None] - prev[:, None] * phi
    e, total = np.zeros_like(phi), np.zeros_like(phi)
    for row in shock:
        e = row - theta * e
        total += e * e
    return total


def _step(w: list[float], phi: float, theta: float) -> tuple[float, float, float, float]:
    """(sum of squares, last residual, Gauss-Newton steps of phi and theta) at one point."""
    e = dp = dt = prev = total = gp = gt = pp = pt = tt = 0.0
    for x in w:
        dp, dt = -prev - theta * dp, -e - theta * dt
        e = x - phi * prev - theta * e
        total += e * e
        gp += dp * e
        gt += dt * e
        pp += dp * dp
        pt += dp * dt
        tt += dt * dt
        prev = x
    det = pp * tt - pt * pt
    if det <= 1e-12 * pp * tt:  # the two parameters can't be told apart: move along the gradient
        scale = pp + tt
        return (total, e, -gp / scale, -gt / scale) if scale else (total, e, 0.0, 0.0)
    return total, e, (pt * gt - tt * gp) / det, (pt * gp - pp * gt) / det


def fit_arma11(w: np.ndarray, *, iterations: int = 50, tolerance: float = 1e-9) -> tuple[float, float, float]:
    """(phi, theta, last residual) minimising the conditional sum of squares: the best grid point, then Gauss-Newton."""
    phis, thetas = (x.ravel() for x in np.meshgrid(GRID, GRID))
    first = int(np.argmin(css_grid(w, phis, thetas)))
    phi, theta, series = float(phis[first]), float(thetas[first]), w.tolist()
    total, last, dp, dt = _step(series, phi, theta)
    for _ in range(iterations):
        share = 1.0
        while share > 1e-4:
            p, t = (min(max(v, -EDGE), EDGE) for v in (phi + share * dp, theta + share * dt))
            tried = _step(series, p, t)
            if tried[0] < total:
                break
            share /= 4
        else:
            break
        moved = max(abs(p - phi), abs(t - theta))
        phi, theta, (total, last, dp, dt) = p, t, tried
        if moved < tolerance:
            break
    return phi, theta, last


def arima_forecast(closes: np.ndarray, steps: int) -> np.ndarray:
    """ARIMA(1,1,1) without trend: forecast close levels."""
    w = np.diff(closes)
    phi, theta, e = fit_arma11(w)
    step = phi * w[-1] + theta * e
    level, out = closes[-1], np.empty(steps)
    for i in range(steps):
        level = level + step
        out[i] = level
        step *= phi
    return out


def arima_111(df: DataFrame, *, target: str = "target", min_rows: int = 10) -> DataFrame:
    """ARIMA(1,1,1) on each symbol's training closes; forecast returns of the bars that follow.

    One fit per symbol; a symbol's daily closes are bounded by the calendar. Symbols with fewer
    than ``min_rows`` training closes get no predictions.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        train = pdf.loc[pdf["split"] == "train", "close"].to_numpy(dtype=float)
        rest = pdf.loc[pdf["split"] != "train"].copy()
        if len(train) < min_rows or rest.empty:
            return rest.iloc[:0].assign(y_true=0.0, y_pred=0.0)[["split", "symbol", "date", "y_true", "y_pred"]]
        levels = arima_forecast(train, len(rest))
        before = np.concatenate([train[-1:], levels[:-1]])
        return rest.assign(y_true=rest[target], y_pred=levels / before - 1.0)[["split", "symbol", "date", "y_true", "y_pred"]]

    rows = df.select("split", "symbol", "date", "close", target)
    out = rows.groupBy("symbol").applyInPandas(
        fit, "split STRING, symbol STRING, date DATE, y_true DOUBLE, y_pred DOUBLE"
    )
    return out.select(F.lit("arima_111").alias("model"), *KEYS, "y_true", "y_pred")


class Baseline(Protocol):
    """What all baselines have in common: fit on the training rows, predict validation and test."""

    name: str
    hyperparameters: dict

    def fit(self, df: DataFrame) -> "Baseline": ...

    def predict(self, df: DataFrame) -> DataFrame: ...


@dataclass
class RandomWalk:
    target: str = "target"
    name: str = "random_walk"
    hyperparameters: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "RandomWalk":
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return random_walk(df, target=self.target)


@dataclass
class HistoricalMean:
    target: str = "target"
    name: str = "historical_mean"
    hyperparameters: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "HistoricalMean":
        self.hyperparameters["mean"] = df.where("split = 'train'").agg(F.avg(self.target)).first()[0]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return _as_predictions(df, self.name, F.lit(self.hyperparameters["mean"]).cast("double"), self.target)


@dataclass
class LinearRegression:
    """Least squares, or ridge where ``alphas`` are given."""

    features: Sequence[str]
    target: str = "target"
    alphas: Sequence[float] | None = None
    model: LinearModel | None = None

    @property
    def name(self) -> str:
        return "linear_regression" if self.alphas is None else "ridge_regression"

    @property
    def hyperparameters(self) -> dict:
        return self.model.hyperparameters if self.model else {}

    def fit(self, df: DataFrame) -> "LinearRegression":
        if self.alphas is None:
            self.model = fit_linear(df, self.features, target=self.target)
        else:
            self.model = fit_ridge(df, self.features, target=self.target, alphas=self.alphas)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("fit first")
        return self.model.predict(df, target=self.target)


@dataclass
class Arima111:
    """One fit per symbol, made where its forecasts are."""

    target: str = "target"
    name: str = "arima_111"
    hyperparameters: dict = field(default_factory=lambda: {"order": [1, 1, 1]})

    def fit(self, df: DataFrame) -> "Arima111":
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return arima_111(df, target=self.target)


def fit_predict(models: Sequence[Baseline], df: DataFrame) -> DataFrame:
    """Predictions of several baselines, each fitted on ``df`` first."""
    return reduce(DataFrame.unionByName, [m.fit(df).predict(df) for m in models])


def fit_report(models: Sequence[Baseline], df: DataFrame) -> DataFrame:
    """(model, hyperparameters as JSON, first and last date and rows of each split) of fitted baselines."""
    spans = [
        a
        for s in ("train", "validation")
        for a in (
            F.min(F.when(F.col("split") == s, F.col("date"))).alias(f"{s}_start_date"),
            F.max(F.when(F.col("split") == s, F.col("date"))).alias(f"{s}_end_date"),
            F.count_if(F.col("split") == s).alias(f"{s}_rows"),
        )
    ]
    cells = F.array(*[F.struct(F.lit(m.name).alias("model"), F.lit(json.dumps(m.hyperparameters)).alias("hyperparameters")) for m in models])
    return df.agg(*spans).select("*", F.inline(cells))


def xy_mismatches(x: DataFrame, y: DataFrame, *, on: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Rows with features but no target, and the other way round; both must be 0 before a fit."""
    left = x.select(*on).withColumn("_x", F.lit(1))
    right = y.select(*on).withColumn("_y", F.lit(1))
    return left.join(right, list(on), "full_outer").agg(
        F.count_if(F.col("_y").isNull()).alias("without_target"), F.count_if(F.col("_x").isNull()).alias("without_features")
    )


def baseline_suite(
    df: DataFrame, *, tier1: Sequence[str], features: Sequence[str], target: str = "target", arima: bool = True
) -> DataFrame:
    """Predictions of all baselines on validation and test.

    The model frame is written once; the fits pass over it, and one scan predicts with all
    one-step models together.
    """
    columns = list(dict.fromkeys([*KEYS, *tier1, *features, target] + (["close"] if arima else [])))
    ready = materialize(df.na.drop(subset=[*features, *tier1, target]).select(*columns), "model-frame")
    mean = ready.where("split = 'train'").agg(F.avg(target)).first()[0]
    linear = fit_linear(ready, tier1, target=target, written=True)
    ridge = fit_ridge(ready, features, target=target, written=True)
    walked = ready.withColumn("_walk", F.lag(target).over(Window.partitionBy("symbol").orderBy("date")))
    models = {
        "random_walk": F.col("_walk"),
        "historical_mean": F.lit(mean).cast("double"),
        linear.name: linear.expression(),
        ridge.name: ridge.expression(),
    }
    cells = F.array(*[F.struct(F.lit(m).alias("model"), e.alias("y_pred")) for m, e in models.items()])
    out = (
        walked.where(F.col("split").isin("validation", "test"))
        .select(*KEYS, F.col(target).alias("y_true"), F.inline(cells))
        .select("model", *KEYS, "y_true", "y_pred")
    )
    return out.unionByName(arima_111(ready, target=target)) if arima else out


def baseline_scores(predictions: DataFrame) -> DataFrame:
    return metrics.point_metrics(predictions).select("model", "split", "n", "mae", "rmse", "directional_accuracy")


def best_baseline(scores: DataFrame) -> DataFrame:
    """The model with the smallest test error, by name on a tie."""
    return scores.where("split = 'test'").agg(
        F.min_by("model", F.struct("mae", "model")).alias("model"), F.min("mae").alias("mae")
    )
