"""Feature ablation: refit without groups of columns and compare."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.linalg import least_squares, moments
from barloom.operators.metrics import metric_bundle
from barloom.sources.sinks import materialize

# Name parts that put a column into an ablation group.
DEFAULT_CATALOG: Mapping[str, tuple[str, ...]] = {
    "rsi": ("rsi_14", "rsi_9", "rsi_21"),
    "macd": ("macd_line", "macd_signal", "macd_histogram"),
    "bollinger": ("bollinger_upper", "bollinger_lower", "bollinger_bandwidth"),
    "tier2": (
        "rsi_14",
        "rsi_9",
        "rsi_21",
        "macd_line",
        "macd_signal",
        "macd_histogram",
        "bollinger_upper",
        "bollinger_lower",
        "bollinger_bandwidth",
        "stochastic_k",
        "stochastic_d",
        "atr_14",
        "adx_14",
        "obv",
        "momentum",
        "volatility",
    ),
    "tier3": ("market_regime", "sector_momentum", "market_beta", "cross_asset_correlation"),
    "wavelet": ("wavelet_approximation", "wavelet_detail", "wavelet_energy"),
    "ssa": ("ssa_component_1", "ssa_component_2", "ssa_reconstruction"),
    "kalman": ("kalman_state", "kalman_smoothed", "kalman_gain"),
    "signal_processing": (
        "wavelet_approximation",
        "wavelet_detail",
        "wavelet_energy",
        "ssa_component_1",
        "ssa_component_2",
        "ssa_reconstruction",
        "kalman_state",
        "kalman_smoothed",
        "kalman_gain",
    ),
}


def default_plan(
    features: Sequence[str], catalog: Mapping[str, Sequence[str]] | None = None
) -> dict[str, list[str]]:
    """remove_<group> -> columns whose lower-case name contains one of the group's parts."""
    groups = {**DEFAULT_CATALOG, **(catalog or {})}
    plan = {}
    for name, parts in groups.items():
        hit = [c for c in features if any(p.lower() in c.lower() for p in parts)]
        if hit:
            plan[f"remove_{name}"] = hit
    return plan


#: Fits a model on (rows with a split, features); the model has an ``expression()`` for its prediction.
ModelFactory = Callable[[DataFrame, Sequence[str]], "object"]


def ablation_predictions(
    df: DataFrame,
    features: Sequence[str],
    plan: Mapping[str, Sequence[str]],
    *,
    target: str = "target",
    model_factory: ModelFactory | None = None,
) -> DataFrame:
    """(name, split, symbol, date, y_true, y_base, y_pred) of the full model and of every ablation.

    One moment pass serves all variants of least squares: each is the solve of a sub-matrix. With a
    ``model_factory`` every variant is fitted by it. All variants are predicted in the one scan that reads the rows.
    """
    df = materialize(df.select("split", "symbol", "date", *features, target), "model-frame")
    table = None if model_factory else moments(df.where("split = 'train'"), features, target, "split")
    variants = {"full_feature_set": list(range(len(features)))}
    for name, removed in plan.items():
        keep = [i for i, c in enumerate(features) if c not in set(removed)]
        if removed and keep and name != "full_feature_set":
            variants[name] = keep

    def dot(keep):
        if model_factory:
            return model_factory(df, [features[i] for i in keep]).expression()
        intercept, coef = least_squares(table, table.groups["train"], keep=keep)
        total = F.lit(intercept)
        for i in keep:
            total = total + F.col(features[i]) * F.lit(float(coef[i]))
        return total

    fitted = {name: dot(keep) for name, keep in variants.items()}
    cells = F.array(*[F.struct(F.lit(n).alias("name"), e.alias("y_pred")) for n, e in fitted.items()])
    return df.where("split <> 'train'").select(
        "split",
        "symbol",
        "date",
        F.col(target).alias("y_true"),
        fitted["full_feature_set"].alias("y_base"),
        F.inline(cells),
    )


def paired_stats(predictions: DataFrame) -> DataFrame:
    """Paired differences of the absolute errors (full model minus ablation): n, mean, deviation, t."""
    d = F.abs(F.col("y_true") - F.col("y_base")) - F.abs(F.col("y_true") - F.col("y_pred"))
    s = predictions.groupBy("name", "split").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_sd")
    )
    t = F.try_divide(F.col("mean_difference"), F.col("_sd") / F.sqrt(F.col("n").cast("double")))
    return s.withColumn("t_statistic", t).drop("_sd")


# Lanczos coefficients of the gamma function for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
BETA_STEPS = 1000


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z >= 0.5."""
    x = z - 1.0
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (x + float(i))
    t = x + 7.5
    return 0.5 * math.log(2.0 * math.pi) + (x + 0.5) * F.ln(t) - t + F.ln(total)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, evaluated from its tail inwards."""

    def step(value: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        return 1.0 + F.when(k % 2 == 0, even).otherwise(odd) / value

    return 1.0 / F.aggregate(F.sequence(F.lit(BETA_STEPS), F.lit(1), F.lit(-1)), F.lit(1.0), step)


def t_test_p_value(t: Column, n: Column) -> Column:
    """Two-sided p-value of a t statistic with n - 1 degrees of freedom; NULL for n < 2."""
    v = n.cast("double") - 1.0
    x = v / (v + t * t)
    a, b = v / 2.0, F.lit(0.5)
    front = F.exp(
        log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(t * t / (v + t * t))
    )
    low = front * _beta_fraction(a, b, x) / a
    high = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    found = F.when(x >= 1.0, 1.0).when(x < (a + 1.0) / (a + b + 2.0), low).otherwise(high)
    return F.when((n >= 2) & t.isNotNull(), found)


def paired_ttest(predictions: DataFrame) -> DataFrame:
    """``paired_stats`` with the p-value."""
    return paired_stats(predictions).withColumn("p_value", t_test_p_value(F.col("t_statistic"), F.col("n")))


METRICS = ("mae", "rmse", "mape", "directional_accuracy", "sharpe_ratio", "information_coefficient")


def ablation_metrics(predictions: DataFrame) -> DataFrame:
    """All metrics per variant and split, and their change against the full model."""
    scores = metric_bundle(predictions, by=("name", "split"))
    base = scores.where("name = 'full_feature_set'").select("split", *[F.col(m).alias(f"_{m}") for m in METRICS])
    # Two rows.
    joined = scores.join(F.broadcast(base), "split")
    return joined.select(
        "name", "split", "n", *METRICS, *[(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in METRICS]
    )


def ablation_summary(metrics: DataFrame) -> DataFrame:
    """One row per ablation with validation and test errors, strongest change of the test error first."""

    def at(split: str, column: str, alias: str):
        return F.max(F.when(F.col("split") == split, F.col(column))).alias(alias)

    return (
        metrics.where("name <> 'full_feature_set'")
        .groupBy(F.col("name").alias("ablation_name"))
        .agg(
            at("validation", "mae", "validation_mae"),
            at("validation", "rmse", "validation_rmse"),
            at("test", "mae", "test_mae"),
            at("test", "rmse", "test_rmse"),
            at("test", "delta_mae", "delta_test_mae"),
            at("test", "delta_rmse", "delta_test_rmse"),
        )
        .orderBy(F.desc(F.abs("delta_test_mae")), "ablation_name")
    )


def tier_contributions(metrics: DataFrame) -> DataFrame:
    """Mean absolute change of the test error per tier, the tier read off the ablation's name."""
    name = F.lower("name")
    has = lambda *parts: name.rlike("|".join(parts))
    tier = (
        F.when(has("tier1", "return", "normalized"), "Tier-1")
        .when(has("tier2", "signal", "wavelet", "ssa", "kalman"), "Tier-2")
        .when(has("tier3", "regime", "cross", "correlation"), "Tier-3")
    )
    rows = metrics.where("name <> 'full_feature_set' AND split = 'test'").withColumn("tier", tier)
    return rows.where("tier IS NOT NULL").groupBy("tier").agg(F.avg(F.abs("delta_mae")).alias("contribution"))


def heat_map(metrics: DataFrame) -> DataFrame:
    """Test deltas of error and direction per ablation, in long form."""
    cells = F.array(
        *[
            F.struct(F.lit(label).alias("metric"), F.col(f"delta_{m}").alias("delta"))
            for m, label in (("mae", "MAE Delta"), ("rmse", "RMSE Delta"), ("directional_accuracy", "Dir.Acc. Delta"))
        ]
    )
    return metrics.where("name <> 'full_feature_set' AND split = 'test'").select("name", F.inline(cells))
