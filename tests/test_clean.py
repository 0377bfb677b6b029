import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom.operators import clean, quality
from tests.helpers import brute_fill, brute_spikes, brute_volume, to_pandas, to_spark, walk

PRICES = ["open", "high", "low", "close"]


def linear(n=20):
    i = np.arange(n)
    days = pd.date_range("2023-01-01", periods=n).date
    return pd.DataFrame(
        dict(symbol="AAA", date=days, open=100 + 0.5 * i, high=102 + 0.5 * i, low=99 + 0.5 * i, close=101 + 0.5 * i, volume=1e6 + 1e4 * i)
    )


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_fill_limited_against_brute_force(spark, seed, k):
    rng = np.random.default_rng(seed)
    frames = []
    for name in ("AAA", "BBB"):
        pdf = walk(name, n=120, seed=seed)
        for c in PRICES:
            pdf.loc[rng.random(len(pdf)) < 0.3, c] = np.nan
        frames.append(pdf)
    got = to_pandas(clean.fill_limited(to_spark(spark, pd.concat(frames)), max_consecutive_days=k))
    want = pd.concat([brute_fill(f, k) for f in frames]).reset_index(drop=True)
    assert list(got["date"]) == list(want["date"])
    np.testing.assert_allclose(got[PRICES].to_numpy(float), want[PRICES].to_numpy(float))


def test_fill_fixture(spark):
    pdf = linear()
    pdf.loc[5:6, ["close", "high"]] = np.nan
    pdf.loc[12:15, "low"] = np.nan
    df = to_spark(spark, pdf)
    out = to_pandas(clean.fill_limited(df))
    assert len(out) == 16
    assert out.loc[5, "close"] == out.loc[6, "close"] == pdf.loc[4, "close"]
    runs = {(r["column"], r["start_date"], r["consecutive_days"]) for r in clean.fill_runs(df).collect()}
    assert runs == {("close", pdf.date[5], 2), ("high", pdf.date[5], 2)}


@pytest.mark.parametrize("share", [0.02, 0.2, 0.6])
def test_volume_medians_cascade(spark, share):
    rng = np.random.default_rng(int(share * 100))
    frames = []
    for name in ("AAA", "BBB", "CCC"):
        pdf = walk(name, n=200, seed=7)
        pdf.loc[rng.random(len(pdf)) < share, "volume"] = np.nan
        frames.append(pdf)
    frames[2]["volume"] = np.nan
    got = to_pandas(clean.fill_volume(to_spark(spark, pd.concat(frames))))
    want = np.concatenate([brute_volume(f) for f in frames])
    np.testing.assert_allclose(got["volume"].to_numpy(float), want)


def test_volume_forward_fill(spark):
    pdf = linear()
    pdf.loc[[0, 4, 5, 6, 7], "volume"] = np.nan
    got = to_pandas(clean.fill_volume(to_spark(spark, pdf), volume_strategy="forward_fill"))
    np.testing.assert_allclose(got["volume"].to_numpy(float), pdf["volume"].ffill().to_numpy())


@pytest.mark.parametrize("seed", range(3))
def test_spikes_against_brute_force(spark, seed):
    frames = [walk(name, n=150, seed=seed + i, step=0.25) for i, name in enumerate(("AAA", "BBB"))]
    got = to_pandas(clean.fix_spikes(clean.mark_spikes(to_spark(spark, pd.concat(frames)))))
    want = pd.concat([brute_spikes(f) for f in frames]).reset_index(drop=True)
    np.testing.assert_allclose(got[PRICES].to_numpy(float), want[PRICES].to_numpy(float), rtol=1e-12)


def test_long_spike_run(spark):
    """Longer than one cut of the power-of-two sums."""
    n = 1300
    pdf = linear(n)
    # Alternating 21% moves with a wide low-volume bar never reach three confirmations.
    pdf["close"] = np.where(np.arange(n) % 2, 125.0, 100.0)
    pdf["high"], pdf["low"], pdf["open"] = 126.0, 125.0, 125.0
    got = to_pandas(clean.fix_spikes(clean.mark_spikes(to_spark(spark, pdf))))
    np.testing.assert_allclose(got["close"], brute_spikes(pdf)["close"], rtol=1e-12)


def test_spike_removal(spark):
    pdf = linear()
    pdf.loc[9, "close"] = 140.0
    out = clean.fix_spikes(clean.mark_spikes(to_spark(spark, pdf)), fix_method="removal")
    assert out.where("date = '2023-01-10'").count() == 0


def test_ohlc_fix_and_exclude(spark):
    pdf = linear()
    pdf.loc[3, ["close", "high"]] = [110, 105]
    pdf.loc[7, ["low", "close"]] = [105, 101]
    df = to_spark(spark, pdf)
    fixed = clean.fix_ohlc(df)
    assert clean.ohlc_violations(fixed).count() == 0
    row = to_pandas(fixed).loc[3]
    assert (row.open, row.low, row.close, row.high) == (101.5, 101.5, 110.0, 110.0)
    assert clean.fix_ohlc(df, fix_method="exclude").count() == 18


def test_missing_zero_negative(spark):
    pdf = linear()
    pdf.loc[1, "open"], pdf.loc[2, "low"], pdf.loc[3, "close"] = 0.0, -1.0, np.nan
    pdf.loc[4, "volume"], pdf.loc[5, "volume"] = 0.0, -5.0
    got = {(r["column"], r["reason"]) for r in clean.detect_missing(to_spark(spark, pdf)).collect()}
    assert got == {("open", "zero"), ("low", "negative"), ("close", "NaN"), ("volume", "zero")}


ACTIONS = "symbol STRING, date DATE, type STRING, factor DOUBLE, amount DOUBLE"


def test_adjustments(spark):
    pdf = linear()
    day = lambda i: pdf.date[i]
    acts = spark.createDataFrame(
        [
            ("AAA", day(10), "split", 2.0, None),
            ("AAA", day(15), "dividend", None, 1.0),
            ("AAA", dt.date(2024, 5, 5), "split", 9.0, None),
        ],
        ACTIONS,
    )
    out = to_pandas(clean.adjust_prices(to_spark(spark, pdf), acts))
    paid = 1 + 1.0 / pdf.close[15]
    assert out.close[16] == pdf.close[16]
    assert out.close[15] == pytest.approx(pdf.close[15] / paid)
    assert out.close[10] == pytest.approx(pdf.close[10] / paid / 2)
    assert out.adj_close[0] == pytest.approx(pdf.close[0] / paid / 2)
    assert (out.volume == pdf.volume).all()
    records = {r["type"]: r for r in clean.adjustment_records(to_spark(spark, pdf), acts).collect()}
    assert records["split"]["before_close"] == pytest.approx(pdf.close[10] / paid)
    assert records["split"]["after_close"] == pytest.approx(pdf.close[10] / paid / 2)


def test_dividend_snaps_to_the_nearest_earlier_bar(spark):
    pdf = linear().drop(index=[5, 6, 7]).reset_index(drop=True)
    acts = spark.createDataFrame([("AAA", dt.date(2023, 1, 7), "dividend", None, 1.0)], ACTIONS)
    got = clean.dividend_nearest(to_spark(spark, pdf), acts).collect()
    assert [r["bar_date"] for r in got] == [dt.date(2023, 1, 5)]
    assert clean.adjustment_records(to_spark(spark, pdf), acts).count() == 0
    assert clean.adjustment_records(to_spark(spark, pdf), acts, snap=True).count() == 1


@pytest.mark.parametrize("n, constant, passed", [(2500, False, True), (2499, False, False), (2500, True, False)])
def test_quality_thresholds(spark, n, constant, passed):
    pdf = walk(n=n, start="2010-01-01")
    if constant:
        pdf[PRICES] = 100.0
    row = quality.quality_report(to_spark(spark, pdf)).first()
    assert row["overall_pass"] is passed
    assert row["stasis_ok"] is not constant


def test_report_and_isolation(spark):
    dirty = linear(100)
    dirty.loc[10:11, "close"] = np.nan
    dirty.loc[20, ["close", "high"]] = [110, 105]
    dirty.loc[30, "close"] = 500
    other = walk("BBB", n=80, seed=5)
    alone = clean.cleaning_report(to_spark(spark, dirty)).where("symbol = 'AAA'").first()
    both = clean.cleaning_report(to_spark(spark, pd.concat([other, dirty]).sample(frac=1, random_state=1)).repartition(7))
    assert both.where("symbol = 'AAA'").first() == alone
    assert (alone["missing_values_detected"], alone["forward_fills_applied"], alone["quality_status"]) == (2, 2, "FAIL")
    assert alone["raw_data_rows"] == 100 and alone["cleaned_data_rows"] == 100


def test_stasis(spark):
    pdf = linear(12)
    pdf.loc[3:8, "close"] = 50.0
    got = clean.stasis_runs(to_spark(spark, pdf)).first()
    assert (got["start_date"], got["end_date"], got["num_days"]) == (pdf.date[3], pdf.date[8], 6)


def test_a_move_from_zero_is_a_spike(spark):
    pdf = linear(4)
    pdf["close"] = [10.0, 0.0, 10.0, 10.0]
    got = sorted((r.date.day, r.daily_return, r.severity) for r in clean.detect_spikes(to_spark(spark, pdf)).collect())
    assert [(x, s) for _, x, s in got] == [(-1.0, "high"), (float("inf"), "high")]
