"""Registered model queries on the whole feature set: least squares on all of tier 1, ridge and ablations on every feature.

Fits on so many columns have no closed form that SQL could say; tests compare them with NumPy on a small fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import ablation, baselines, metrics, quality, split
from barloom.operators import features as ft
from barloom.plans.entries import Entry, entry, same
from barloom.plans.model_queries import DRAWS, _with_id
from barloom.sources import bars as src
from barloom.sources.sinks import materialize


def columns(tier: int | None = None) -> list[str]:
    """Names of all built-in features, or of one tier."""
    return [c for f in ft.default_features().values() if tier in (None, f.tier) for c in f.outputs]


def wide_frame(spark, sf) -> DataFrame:
    """Bars with every built-in feature, the next return as target and the split label, written once."""
    df = ft.compute_features(src.bars(spark, sf))
    numbers = [F.col(c).cast("double").alias(c) for c in columns()]
    df = materialize(split.target_return(df).select("symbol", "date", "close", *numbers, "target"), "wide-frame")
    return quality.drop_warmup(split.chrono_split(df), [*columns(), "target"])


def _fits(spark, sf) -> tuple[baselines.LinearModel, baselines.LinearModel]:
    df = wide_frame(spark, sf)
    return baselines.fit_linear(df, columns(1), written=True), baselines.fit_ridge(df, columns(), written=True)


def _coefficients(spark, sf) -> DataFrame:
    tables = [m.table(spark).withColumn("model", F.lit(m.name)) for m in _fits(spark, sf)]
    return tables[0].unionByName(tables[1])


def wide_predictions(spark, sf) -> DataFrame:
    return baselines.baseline_suite(wide_frame(spark, sf), tier1=columns(1), features=columns(), arima=False)


def wide_ablations(spark, sf) -> DataFrame:
    return ablation.ablation_predictions(wide_frame(spark, sf), columns(), ablation.default_plan(columns()))


def _intervals(spark, sf) -> DataFrame:
    rows = materialize(_with_id(wide_predictions(spark, sf)), "predictions")
    sums = metrics.bootstrap_ci(rows, id_col="row_id", n_bootstrap=DRAWS).select("model", "split", "metric", "ci_lower", "ci_upper")
    ranks = metrics.bootstrap_ic(rows, id_col="row_id", n_bootstrap=DRAWS)
    return sums.unionByName(ranks.select("model", "split", "metric", "ci_lower", "ci_upper"))


SCORES = "mae rmse directional_accuracy"

ENTRIES: dict[str, Entry] = {
    "wide_coefficients": entry(_coefficients, keys=("model", "feature"), digits={"coefficient": 9}),
    "wide_baseline_scores": entry(
        lambda spark, sf: baselines.baseline_scores(wide_predictions(spark, sf)), keys=("model", "split", "n"), digits=same(SCORES)
    ),
    "wide_metric_bundle": entry(
        lambda spark, sf: metrics.metric_bundle(wide_predictions(spark, sf)),
        keys=("model", "split", "n"),
        digits=same(f"{SCORES} mape sharpe_ratio information_coefficient"),
    ),
    "wide_bootstrap": entry(_intervals, keys=("model", "split", "metric"), digits=same("ci_lower ci_upper", 5)),
    "wide_ablation_default_plan": entry(
        lambda spark, sf: ablation.ablation_metrics(wide_ablations(spark, sf)),
        keys=("name", "split", "n"),
        digits=same("mae rmse information_coefficient delta_mae delta_rmse"),
    ),
    "wide_paired_ttest": entry(
        lambda spark, sf: ablation.paired_ttest(wide_ablations(spark, sf)),
        keys=("name", "split", "n"),
        digits=same("mean_difference t_statistic p_value"),
    ),
}
