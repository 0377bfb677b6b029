import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.blocks import carried, in_blocks, in_slices, running_total, with_position
from barloom.functions.guards import broadcast_if_small, collect_bounded
from barloom.functions.ranks import average_ranks, exact_percentiles
from barloom.functions.recurrence import Ewm, ewm
from barloom.operators import features as ft
from barloom.operators.align import asof_join
from tests.helpers import ticks, to_pandas, to_spark, walk

TICKS = "symbol STRING, date TIMESTAMP, close DOUBLE, volume DOUBLE"


@pytest.mark.parametrize("gaps", ["none", "some", "long"])
def test_ewm_matches_pandas(spark, gaps):
    pdf = walk(n=3000, seed=1)
    rng = np.random.default_rng(2)
    if gaps == "some":
        pdf.loc[rng.random(len(pdf)) < 0.2, "close"] = np.nan
    if gaps == "long":
        pdf.loc[5:9, "close"] = np.nan
        pdf.loc[500:2600, "close"] = np.nan
    pdf.loc[:2, "close"] = np.nan
    got = to_pandas(ewm(to_spark(spark, pdf), [Ewm("a", "close", 2), Ewm("b", "close", 14), Ewm("c", "close", 60)]))
    for name, span in (("a", 2), ("b", 14), ("c", 60)):
        want = pdf["close"].ewm(span=span, adjust=False).mean()
        np.testing.assert_allclose(got[name], want, rtol=1e-9)


def test_dense_ewm_equals_general_and_refuses_gaps(spark):
    pdf = walk(n=5000, seed=4)
    pdf.loc[:1, "close"] = np.nan
    df = to_spark(spark, pdf)
    specs = [Ewm("a", "close", 9), Ewm("b", "close", 26)]
    got = to_pandas(ewm(df, specs, gaps=False))
    for s in specs:
        want = pdf["close"].ewm(span=s.span, adjust=False).mean()
        np.testing.assert_allclose(got[s.out], want, rtol=1e-9)
    pdf.loc[100, "close"] = np.nan
    with pytest.raises(Exception, match="gaps"):
        ewm(to_spark(spark, pdf), specs, gaps=False).collect()


def test_blocks_equal_the_whole_series(spark):
    df = spark.createDataFrame(ticks(), TICKS)
    op = lambda d: ft.compute_features(d, [ft.returns(), ft.normalized_prices(), ft.momentum()])
    cols = ["simple_return", "close_ma20", "normalized_close", "momentum_60"]
    whole = to_pandas(op(df))
    for size in (64, 300, 5000):
        parts = to_pandas(in_blocks(df, op, halo=61, rows_per_block=size))
        assert len(parts) == len(whole)
        for c in cols:
            np.testing.assert_allclose(parts[c], whole[c], rtol=1e-9)


def test_running_total_and_position(spark):
    burst = [("hot", dt.datetime(2024, 1, 3, 0, 0, i // 50, i % 50 * 1000 + 7), 1.0, 2.0) for i in range(900)]
    df = spark.createDataFrame(ticks() + burst, TICKS)
    slices = in_slices(df, symbol_col="symbol", order_col="date", rows_per_slice=50).groupBy("_slice").count()
    assert slices.agg(F.max("count")).first()[0] <= 50
    got = to_pandas(with_position(running_total(df, F.col("volume"), "total", rows_per_slice=50), rows_per_slice=70))
    want = to_pandas(df)
    np.testing.assert_allclose(got["total"], want.groupby("symbol")["volume"].cumsum())
    assert (got["_pos"] == want.groupby("symbol").cumcount()).all()


def test_one_instant_of_many_rows(spark):
    """1e5 rows at one instant: slices stay short, every row gets one place, and a second run gives the same."""
    n, at = 100_000, dt.datetime(2024, 1, 3)
    df = spark.range(n).select(F.lit("hot").alias("symbol"), F.lit(at).alias("date"), "id", (F.col("id") % 7).cast("double").alias("volume"))
    assert in_slices(df, symbol_col="symbol", order_col="date", rows_per_slice=1024).groupBy("_slice").count().agg(F.max("count")).first()[0] <= 1024
    once, again = (
        running_total(with_position(x, rows_per_slice=1024), F.col("volume"), "total", rows_per_slice=1024).toPandas().sort_values("id")
        for x in (df, df.repartition(13))
    )
    assert sorted(once["_pos"]) == list(range(n))
    assert (once["_pos"].to_numpy() == again["_pos"].to_numpy()).all() and (once["total"].to_numpy() == again["total"].to_numpy()).all()
    assert once["total"].max() == once["volume"].sum()
    asked = df.where("id % 3 = 0").select("symbol", "date", "id")
    known = df.where("id % 3 = 1").select("symbol", "date", F.col("id").alias("v"))
    found = asof_join(asked, known, by="symbol", value_cols=["v"], rows_per_slice=1024).select("v").distinct().collect()
    assert len(found) == 1 and found[0].v % 3 == 1


@pytest.mark.parametrize("last", [False, True])
def test_totals_over_a_tree(spark, monkeypatch, last):
    monkeypatch.setattr("barloom.functions.blocks.CHILDREN", 2)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"symbol": rng.choice(["a", "b", "c"], 3000, p=[0.9, 0.05, 0.05]), "_slice": rng.permutation(10**6)[:3000], "v": rng.integers(0, 9, 3000)})
    known = rng.random(3000) < (0.3 if last else 1)
    pdf["v"] = pdf["v"].astype(float).where(known)
    rows = [(s, int(k), float(v) if seen else None) for s, k, v, seen in zip(pdf["symbol"], pdf["_slice"], pdf["v"], known)]
    totals = spark.createDataFrame(rows, "symbol string, _slice long, v double")
    got = carried(totals, "v", "out", symbol_col="symbol", last=last, most=20).toPandas().sort_values(["symbol", "_slice"])
    want = pdf.sort_values(["symbol", "_slice"])
    by = want.groupby("symbol")["v"]
    want = by.transform(lambda x: x.ffill().shift()) if last else by.transform(lambda x: x.cumsum().shift(fill_value=0))
    np.testing.assert_array_equal(got["out"].to_numpy(dtype=float), want.to_numpy())


def test_sliced_asof_join(spark):
    rng = np.random.default_rng(0)
    left = pd.DataFrame({"k": rng.choice(["a", "b"], 500, p=[0.9, 0.1]), "date": pd.to_datetime(rng.choice(10_000, 500, replace=False), unit="s"), "id": range(500)})
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 60), "date": pd.to_datetime(rng.choice(10_000, 60, replace=False), unit="s"), "v": rng.random(60)})
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), by="k", value_cols=["v"], rows_per_slice=20)
    got = got.toPandas().sort_values("id")["v"].to_numpy(dtype=float)
    want = pd.merge_asof(left.sort_values("date"), right.sort_values("date"), on="date", by="k").sort_values("id")["v"]
    np.testing.assert_allclose(got, want)


def test_average_ranks_with_heavy_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    x[rng.random(3000) < 0.4] = 0.0
    pdf = pd.DataFrame({"g": rng.choice(["u", "v"], 3000), "i": range(3000), "x": x, "y": np.round(rng.normal(size=3000), 1)})
    got = average_ranks(spark.createDataFrame(pdf), ["g"], {"x": "rx", "y": "ry"}, rows_per_slice=64).toPandas().sort_values("i")
    np.testing.assert_allclose(got["rx"], pdf.groupby("g")["x"].rank())
    np.testing.assert_allclose(got["ry"], pdf.groupby("g")["y"].rank())


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_exact_percentiles(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"g": "u", "a": rng.lognormal(size=n), "b": np.round(rng.normal(size=n), 1)})
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = exact_percentiles(spark.createDataFrame(pdf), ["g"], ["a", "b"], probs, accuracy=50).collect()
    for row in got:
        np.testing.assert_allclose(row["q"], np.quantile(pdf[row["feature"]], probs))


def test_guards(spark):
    df = spark.range(100)
    assert "ResolvedHint" in broadcast_if_small(df)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_if_small(df, limit=10)._jdf.queryExecution().analyzed().toString()
    with pytest.raises(ValueError):
        collect_bounded(df, limit=10)
