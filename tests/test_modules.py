"""Feature modules: rules, causality over several inputs, and the order of an ingest sequence."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import modules, quality
from barloom.plans import module_queries as mq

SF = "/root/testdata/sf0.001"


def test_causality_of_signal_and_cross_asset_features(spark):
    found = {r.feature: r.violations for r in mq._causality(spark, SF).collect()}
    assert set(found) == {*mq.KALMAN, *mq.WAVELET, *mq.SSA, *mq.CROSS, "volume_share", "planted_leak", "late_market"}
    assert {c for c, n in found.items() if n} == {"planted_leak", "late_market"}


def frames(spark):
    days = pd.date_range("2024-01-01", periods=9).date
    bars = pd.DataFrame([(s, d, float(i + 1), 2.0) for s in "ab" for i, d in enumerate(days)], columns=["symbol", "date", "close", "volume"])
    market = pd.DataFrame([("M", d, float(i)) for i, d in enumerate(days)], columns=["ticker", "date", "close"])
    return {"bars": spark.createDataFrame(bars), "market": spark.createDataFrame(market)}


def test_leaks_of_every_kind_are_counted(spark):
    both = frames(spark)

    def op(f):
        later = f["market"].withColumn("date", F.date_sub("date", 1)).select("date", F.col("close").alias("tomorrow"))
        return f["bars"].join(later, "date", "left").withColumn("own", F.col("close"))

    found = {r.feature: r.violations for r in modules.frames_causality(both, op, ["tomorrow", "own"]).collect()}
    # Each of the three cut-offs shows at its own day, for both symbols.
    assert found == {"tomorrow": 6, "own": 0}
    gone = {r.feature: r.violations for r in modules.frames_causality(both, lambda f: f["bars"].join(f["market"].agg(F.max("close").alias("m")).where("m = 8"), F.lit(True)), ["m"]).collect()}
    assert gone["m"] == 2 * (1 + 4 + 8)  # rows that vanish count
    with pytest.raises(ValueError):
        modules.cut_dates({"bars": both["bars"].where("date < '2024-01-02'")}, 3)


def test_registry_runs_modules_in_order(spark):
    double = modules.Module("double", 1, ("twice",), lambda f: f["bars"].withColumn("twice", F.col("close") * 2), {"positive": F.col("twice") > 0, "small": F.col("twice") < 10})
    again = modules.Module("again", 2, ("four",), lambda f: f["bars"].withColumn("four", F.col("twice") * 2))
    both = modules.ModuleRegistry([double, again])
    out = both.compute(frames(spark))
    assert out.columns == ["symbol", "date", "close", "volume", "twice", "four"]
    assert all(r.four == 4 * r.close for r in out.collect())
    assert both.compute(frames(spark), tiers=[1]).columns[-1] == "twice"
    assert {(r.module, r.rule): r.failures for r in both.validate(frames(spark)).collect()} == {("double", "positive"): 0, ("double", "small"): 10}
    assert {r.module: r.violations for r in both.causality(frames(spark)).collect()} == {"double": 0, "again": 0}
    with pytest.raises(ValueError):
        both.register(double)


def test_order_of_an_ingest_sequence(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 5000
    pdf = pd.DataFrame({"symbol": rng.choice(["hot", "b"], n, p=[0.95, 0.05]), "seq": rng.permutation(n)})
    pdf["date"] = pd.to_datetime(np.sort(rng.integers(0, 10**6, n))[pdf["seq"]], unit="s")
    moved = rng.random(n) < 0.1
    pdf.loc[moved, "date"] = pd.to_datetime(rng.integers(0, 10**6, moved.sum()), unit="s")
    got = {r.symbol: (r.duplicate_dates, r.out_of_order) for r in quality.temporal_alignment(spark.createDataFrame(pdf), seq_col="seq").collect()}
    for s, own in pdf.sort_values("seq").groupby("symbol"):
        assert got[s] == (own["date"].duplicated().sum(), (own["date"].diff() < pd.Timedelta(0)).sum())
