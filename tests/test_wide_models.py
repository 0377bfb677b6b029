"""Fits on the whole feature set against NumPy."""

import numpy as np
import pytest

from barloom.operators import ablation, baselines, metrics
from barloom.plans import wide_queries as wide

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    return wide.wide_frame(spark, SF)


def plain_fit(pdf, features, alpha=0.0):
    """(mean of y, means, coefficients) with the penalty on standardised features."""
    train = pdf[pdf.split == "train"]
    x, y = train[features].to_numpy(float), train["target"].to_numpy()
    sd = x.std(axis=0)
    sd[sd == 0] = 1
    z = (x - x.mean(axis=0)) / sd
    if alpha:
        w = np.linalg.solve(z.T @ z + alpha * np.eye(len(features)), z.T @ (y - y.mean()))
    else:
        w = np.linalg.lstsq(z, y - y.mean(), rcond=1e-10)[0]
    return y.mean(), x.mean(axis=0), w / sd


def plain_predictions(pdf, features, fit):
    mean, centre, w = fit
    return mean + (pdf[features].to_numpy(float) - centre) @ w


def test_linear_and_ridge_predictions(spark, frame):
    pdf = frame.toPandas()
    tier1, every = wide.columns(1), wide.columns()
    assert len(tier1) >= 5 and len(every) >= 20
    rest = pdf[pdf.split != "train"].sort_values(["symbol", "date"])
    got = baselines.baseline_suite(frame, tier1=tier1, features=every, arima=False).toPandas()

    def own(model):
        return got[got.model == model].sort_values(["symbol", "date"])["y_pred"].to_numpy()

    np.testing.assert_allclose(own("linear_regression"), plain_predictions(rest, tier1, plain_fit(pdf, tier1)), atol=1e-7)
    validation = rest[rest.split == "validation"]
    errors = [np.mean((plain_predictions(validation, every, plain_fit(pdf, every, a)) - validation["target"]) ** 2) for a in baselines.ALPHAS]
    best = baselines.ALPHAS[int(np.argmin(errors))]
    np.testing.assert_allclose(own("ridge_regression"), plain_predictions(rest, every, plain_fit(pdf, every, best)), atol=1e-7)


def test_default_ablations(spark, frame):
    pdf, every = frame.toPandas(), wide.columns()
    plan = ablation.default_plan(every)
    assert {"remove_rsi", "remove_macd", "remove_tier2", "remove_tier3"} <= plan.keys()
    got = ablation.ablation_predictions(frame, every, plan).toPandas()
    rest = pdf[pdf.split != "train"].sort_values(["symbol", "date"])
    for name, removed in plan.items():
        kept = [c for c in every if c not in removed]
        want = plain_predictions(rest, kept, plain_fit(pdf, kept))
        np.testing.assert_allclose(got[got.name == name].sort_values(["symbol", "date"])["y_pred"], want, atol=1e-6)


def test_metrics_of_wide_models(spark):
    rows = wide.wide_predictions(spark, SF).dropna()
    pdf = rows.toPandas()
    for r in metrics.metric_bundle(rows).collect():
        own = pdf[(pdf.model == r["model"]) & (pdf.split == r["split"])]
        assert r["n"] == len(own) and r["mae"] == pytest.approx((own.y_pred - own.y_true).abs().mean())
        if own.y_pred.nunique() > 1:
            assert r["information_coefficient"] == pytest.approx(own.y_true.rank().corr(own.y_pred.rank()))
