"""Registered queries: feature checks, splits, scaling, leakage, baselines, metrics, ablation, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import ablation, baselines, clean, leakage, metrics, quality, reports, scale, split
from barloom.operators import features as ft
from barloom.plans import cleaning_queries as cq
from barloom.plans.entries import Entry, entry, same
from barloom.plans.oracle import W, roll, sql
from barloom.sources import bars as src
from barloom.sources import sinks

X = ("simple_return", "momentum_5", "volatility_20")
X2 = ("simple_return", "momentum_5")


def labelled(spark, sf) -> DataFrame:
    """Bars with three features, the next return as target, and the split label."""
    df = ft.compute_features(src.bars(spark, sf), [ft.returns(), ft.momentum((5,)), ft.volatility()])
    return split.chrono_split(split.target_return(df))


def ready(spark, sf) -> DataFrame:
    return quality.drop_warmup(labelled(spark, sf), [*X, "target"])


_FRAME = {
    "feat": f"""SELECT symbol, date, close, ret AS simple_return, close / lag(close, 5) OVER ({W}) - 1 AS momentum_5, {roll('stddev_samp', 'ret', 20)} AS volatility_20,
      lead(ret) OVER ({W}) AS target FROM base""",
    "days": "SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)",
    "cut": """SELECT min(date) AS train_start_date, max(date) FILTER (WHERE i = floor(n * 0.7e0)) AS train_end_date, max(date) FILTER (WHERE i = floor(n * 0.7e0) + 1) AS val_start_date,
      max(date) FILTER (WHERE i = floor(n * 0.7e0) + floor(n * 0.15e0)) AS val_end_date, max(date) FILTER (WHERE i = floor(n * 0.7e0) + floor(n * 0.15e0) + 1) AS test_start_date, max(date) AS test_end_date FROM days""",
    "labelled": """SELECT f.*, CASE WHEN date <= (SELECT train_end_date FROM cut) THEN 'train' WHEN date <= (SELECT val_end_date FROM cut) THEN 'validation' ELSE 'test' END AS split FROM feat f""",
    "ready": "SELECT * FROM labelled WHERE simple_return IS NOT NULL AND momentum_5 IS NOT NULL AND volatility_20 IS NOT NULL AND target IS NOT NULL",
}


def _sql(body: str, **extra: str) -> str:
    return sql(body, "base", **_FRAME, **extra)


# Feature checks

CHECKED = ("simple_return", "close_ma20", "close_std20", "normalized_close", "normalized_volume", "bb_width", "stoch_k", "atr_14", "momentum_20", "volatility_20", "market_regime")


def _checked(spark, sf) -> DataFrame:
    chosen = [
        ft.returns(),
        ft.normalized_prices(),
        ft.bollinger(),
        ft.stochastic(),
        ft.atr(),
        ft.momentum((20,)),
        ft.volatility(),
        ft.market_regime(vol_threshold=0.13),
    ]
    return ft.compute_features(src.bars(spark, sf), chosen)


_CHECKED = {
    "pre": f"""SELECT *, {roll('avg', 'close', 20)} AS close_ma20, {roll('stddev_samp', 'close', 20)} AS close_std20, {roll('avg', 'volume', 20)} AS vma, {roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi,
      greatest(high - low, abs(high - prev), abs(low - prev)) AS tr, {roll('stddev_samp', 'ret', 20)} AS volatility_20, close / lag(close, 60) OVER ({W}) - 1 AS trend, {roll('stddev_samp', 'ret', 60)} AS vol60 FROM base""",
    "checked": f"""SELECT symbol, date, ret AS simple_return, close_ma20, close_std20, (close - close_ma20) / NULLIF(close_std20, 0) AS normalized_close, volume / NULLIF(vma, 0) AS normalized_volume, 4 * close_std20 AS bb_width,
      100 * (close - lo) / NULLIF(hi - lo, 0) AS stoch_k, {roll('avg', 'tr', 14)} AS atr_14, close / lag(close, 20) OVER ({W}) - 1 AS momentum_20, volatility_20,
      CASE WHEN trend IS NULL OR vol60 IS NULL THEN NULL WHEN vol60 > 0.13 THEN 3 WHEN trend > 0.02 THEN 2 WHEN trend < -0.02 THEN 0 ELSE 1 END AS market_regime FROM pre""",
}


def _per_feature(body: str, names=CHECKED) -> str:
    """Union over the features; {c} is the column."""
    return " UNION ALL ".join(body.format(c=c) for c in names)


#: What the names of the checked features allow, written out for the answers.
_LIMITS = {"close_std20": (0.0, None), "stoch_k": (0.0, 100.0), "volatility_20": (0.0, None)}
_RULES = {
    "normalized_close": (-10.0, 10.0), "normalized_volume": (0.0, None), "stoch_k": (-0.01, 100.01), "atr_14": (-1e-6, None),
    "volatility_20": (-1e-6, None), "market_regime": (0.0, 3.0),
}


def _range_sql(c: str) -> str:
    lo, hi = _LIMITS.get(c, (None, None))
    bad = " OR ".join(
        ([f"coalesce(min({c}) < {lo}, false)"] if lo is not None else []) + ([f"coalesce(max({c}) > {hi}, false)"] if hi is not None else [])
    )
    extreme = "greatest(abs(min({c})), abs(max({c}))) > 5".format(c=c) if "return" in c and not bad else "false"
    return f"SELECT symbol, '{c}' AS feature, min({c}) AS min_value, max({c}) AS max_value, NOT ({bad or 'false'}) AS range_ok, {extreme} AS extreme FROM checked GROUP BY symbol"


_JUMPED = tuple(c for c in CHECKED if "return" not in c)
_JUMP = {
    **{
        f"d_{c}": f"SELECT symbol, abs({c}) - lag(abs({c})) OVER ({W}) AS d FROM checked WHERE {c} IS NOT NULL"
        for c in _JUMPED
    },
    **{
        f"j_{c}": f"SELECT d.symbol, '{c}' AS feature, count(*) AS n, count(*) FILTER (WHERE d > 5 * q) AS large_jumps FROM d_{c} d JOIN (SELECT symbol, quantile_cont(d, 0.95) AS q FROM d_{c} GROUP BY symbol) q ON q.symbol = d.symbol GROUP BY d.symbol"
        for c in _JUMPED
    },
    "jumps": " UNION ALL ".join(f"SELECT *, n >= 100 AND large_jumps > 0.05 * n AS jump_warning FROM j_{c}" for c in _JUMPED),
}
WARMUP = 60
_VALID = {
    "nans": _per_feature("SELECT symbol, '{c}' AS feature, count(*) - count({c}) AS nan_count, 0 AS inf_count FROM checked GROUP BY symbol"),
    "ranges": " UNION ALL ".join(_range_sql(c) for c in CHECKED),
    **_JUMP,
    "validation": f"""SELECT n.symbol, n.ok AS nan_values, true AS infinite_values, r.ok AS value_ranges, j.ok AS causality, true AS temporal_alignment, n.ok AND r.ok AS is_valid
      FROM (SELECT symbol, bool_and(nan_count <= {WARMUP}) AS ok FROM nans GROUP BY symbol) n JOIN (SELECT symbol, bool_and(range_ok) AS ok FROM ranges GROUP BY symbol) r USING (symbol)
      JOIN (SELECT symbol, bool_and(NOT jump_warning) AS ok FROM jumps GROUP BY symbol) j USING (symbol)""",
}


def _validation(spark, sf):
    return quality.feature_validation(_checked(spark, sf), CHECKED, expected_nan_rows=WARMUP)


def _rule_sql(c: str) -> str:
    lo, hi = _RULES[c]
    bad = " OR ".join(([f"{c} < {lo!r}"] if lo is not None else []) + ([f"{c} > {hi!r}"] if hi is not None else []))
    return f"SELECT symbol, '{c}' AS feature, count(*) FILTER (WHERE {bad}) AS out_of_range, count(*) FILTER (WHERE {bad}) = 0 AS passed FROM checked GROUP BY symbol"


# Leakage inputs: orders as row ids, with planted faults


def _split_rows(spark, sf) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    part = lambda name, cond, shift=0: o.where(cond).select(
        F.lit(name).alias("split"), (F.col("o_orderkey") + shift).alias("row_id")
    )
    chosen = [
        part("train", "o_orderkey % 10 < 6"),
        part("train", "o_custkey % 1000 = 1", 1_000_000_000_000),
        part("validation", "o_orderkey % 10 IN (6, 7) OR o_custkey % 97 = 0"),
        part("test", "o_orderkey % 10 = 8 OR o_custkey % 101 = 0"),
    ]
    return reduce(DataFrame.unionByName, chosen)


_ROWS = {
    "split_rows": """SELECT 'train' AS split, o_orderkey AS row_id FROM orders WHERE o_orderkey % 10 < 6
      UNION ALL SELECT 'train', o_orderkey + 1000000000000 FROM orders WHERE o_custkey % 1000 = 1
      UNION ALL SELECT 'validation', o_orderkey FROM orders WHERE o_orderkey % 10 IN (6, 7) OR o_custkey % 97 = 0
      UNION ALL SELECT 'test', o_orderkey FROM orders WHERE o_orderkey % 10 = 8 OR o_custkey % 101 = 0""",
    "per_id": """SELECT row_id, count(*) AS n, max((split = 'train')::INT) AS t, max((split = 'validation')::INT) AS v, max((split = 'test')::INT) AS s FROM split_rows GROUP BY row_id""",
    "found": """SELECT count(*) FILTER (WHERE t + v = 2) AS tv, count(*) FILTER (WHERE t + s = 2) AS ts, count(*) FILTER (WHERE v + s = 2) AS vs, CAST(sum(n) - count(*) AS BIGINT) AS dup,
      count(*) FILTER (WHERE row_id >= (SELECT count(*) FROM orders)) AS out, (SELECT count(*) FROM orders) - count(*) FILTER (WHERE row_id < (SELECT count(*) FROM orders)) AS open FROM per_id""",
    "violations": """SELECT * FROM (SELECT 'train_val_overlap' AS violation_type, 'CRITICAL' AS severity, 'train/validation' AS affected, tv AS violations FROM found
      UNION ALL SELECT 'train_test_overlap', 'CRITICAL', 'train/test', ts FROM found UNION ALL SELECT 'val_test_overlap', 'CRITICAL', 'validation/test', vs FROM found
      UNION ALL SELECT 'duplicate_indices', 'ERROR', 'all', dup FROM found UNION ALL SELECT 'invalid_indices', 'ERROR', 'all', out FROM found
      UNION ALL SELECT 'incomplete_coverage', 'WARNING', 'all', open FROM found) WHERE violations > 0""",
}
VIOLATION = ("violation_type", "severity", "affected", "violations")


def _leak_split(spark, sf) -> DataFrame:
    total = spark.read.parquet(f"{sf}/orders.parquet").count()
    return leakage.leak_split(_split_rows(spark, sf), total)


def _folds(spark, sf) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    own = o.select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    side = F.when(F.col("o_orderkey") % 5 == F.col("fold"), "test").otherwise("train")
    regular = own.select("fold", side.alias("side"), F.col("o_orderkey").alias("row_id"))
    extra = own.where("fold = 3 AND o_custkey % 50 = 0").select(
        "fold", F.lit("test").alias("side"), F.col("o_orderkey").alias("row_id")
    )
    return regular.unionByName(extra)


# Predictions


def predictions(spark, sf) -> DataFrame:
    """Random walk, mean, least squares and ridge on two features."""
    return baselines.baseline_suite(ready(spark, sf), tier1=X2, features=X2, arima=False)


_LS = """SELECT avg(target) AS my, avg(simple_return) AS m1, avg(momentum_5) AS m2, var_pop(simple_return) AS v1, var_pop(momentum_5) AS v2, covar_pop(simple_return, momentum_5) AS c12,
  covar_pop(simple_return, target) AS c1y, covar_pop(momentum_5, target) AS c2y, count(*) AS n FROM ready WHERE split = 'train'"""
_EVAL = "split IN ('validation', 'test')"
_PREDICTIONS = {
    "ls": _LS,
    "ols": "SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1, (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2 FROM ls",
    # z = (x - m) / sd: Z'Z / n = [1 r; r 1]
    "grid": "SELECT pow(10e0, -3 + 6e0 * i / 49) AS alpha FROM range(50) t(i)",
    "rw0": "SELECT *, c12 / sqrt(v1 * v2) AS r, c1y / sqrt(v1) AS z1, c2y / sqrt(v2) AS z2 FROM ls, grid",
    "rw": """SELECT *, ((z1 * (1 + alpha / n) - r * z2) / (pow(1 + alpha / n, 2) - r * r)) / sqrt(v1) AS b1, ((z2 * (1 + alpha / n) - r * z1) / (pow(1 + alpha / n, 2) - r * r)) / sqrt(v2) AS b2 FROM rw0""",
    "rerr": """SELECT alpha, avg(pow(my + b1 * (simple_return - m1) + b2 * (momentum_5 - m2) - target, 2)) AS mse FROM rw, ready WHERE split = 'validation' GROUP BY alpha""",
    "rbest": "SELECT * FROM rw WHERE alpha = (SELECT arg_min(alpha, mse) FROM rerr)",
    "walked": f"SELECT *, lag(target) OVER ({W}) AS pt FROM ready",
    "pred": f"""SELECT 'random_walk' AS model, split, symbol, date, target AS y_true, pt AS y_pred FROM walked WHERE {_EVAL}
      UNION ALL SELECT 'historical_mean', split, symbol, date, target, (SELECT my FROM ls) FROM ready WHERE {_EVAL}
      UNION ALL SELECT 'linear_regression', split, symbol, date, target, my + b1 * (simple_return - m1) + b2 * (momentum_5 - m2) FROM ready, ols WHERE {_EVAL}
      UNION ALL SELECT 'ridge_regression', split, symbol, date, target, my + b1 * (simple_return - m1) + b2 * (momentum_5 - m2) FROM ready, rbest WHERE {_EVAL}""",
    "known": "SELECT * FROM pred WHERE y_true IS NOT NULL AND y_pred IS NOT NULL",
}


def _metric_sql(by: str, source: str = "known") -> str:
    return f"""SELECT {by}, count(*) AS n, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse,
      CASE WHEN count(*) FILTER (WHERE abs(y_true) > 1e-8) > 0 THEN 100 * avg(abs((y_pred - y_true) / y_true)) FILTER (WHERE abs(y_true) > 1e-8) WHEN bool_and(abs(y_pred) <= 1e-8) THEN 0 END AS mape,
      count(*) FILTER (WHERE abs(y_true) <= 1e-8) AS zero_actuals_excluded, avg((sign(y_true) = sign(y_pred))::INT) AS directional_accuracy,
      CASE WHEN stddev_pop(y_pred) > 1e-8 THEN avg(y_pred) / stddev_pop(y_pred) WHEN abs(avg(y_pred)) <= 1e-8 THEN 0 END AS sharpe_ratio FROM {source} GROUP BY {by}"""


def _ranks_sql(by: str, source: str = "known") -> dict[str, str]:
    return {
        "rk": f"SELECT *, rank() OVER (PARTITION BY {by} ORDER BY y_true) + (count(*) OVER (PARTITION BY {by}, y_true) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY {by} ORDER BY y_pred) + (count(*) OVER (PARTITION BY {by}, y_pred) - 1) / 2e0 AS rp FROM {source}",
        "ic": f"SELECT {by}, covar_pop(ra, rp) / NULLIF(stddev_pop(ra) * stddev_pop(rp), 0) AS information_coefficient FROM rk GROUP BY {by}",
    }


def _pred_sql(body: str, **extra: str) -> str:
    return _sql(body, **_PREDICTIONS, **extra)


# Bootstrap

DRAWS = 1000
_IDS = "CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS BIGINT) * 100000 + (date - DATE '1970-01-01')"
_M64 = "18446744073709551616::UHUGEINT"


def _mix(z: str, shift: int, factor: int) -> str:
    return f"CAST((xor({z}, {z} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {_M64} AS UBIGINT)"


_CDF = [float(x) for x in metrics.POISSON_CDF]


def _weights(rows: str, columns: str, draws: int = DRAWS) -> dict[str, str]:
    steps = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in _CDF)
    return {
        "ids": f"SELECT DISTINCT symbol, date, {_IDS} AS id FROM {rows}",
        "w0": f"SELECT symbol, date, draw, CAST((id::UHUGEINT * {metrics.GAMMA}::UHUGEINT + 42::UHUGEINT + (draw + 1)::UHUGEINT * {metrics.MIX_1}::UHUGEINT) % {_M64} AS UBIGINT) AS z FROM ids, range({draws}) t(draw)",
        "w1": f"SELECT * EXCLUDE (z), {_mix('z', 30, metrics.MIX_1)} AS z FROM w0",
        "w2": f"SELECT * EXCLUDE (z), {_mix('z', 27, metrics.MIX_2)} AS z FROM w1",
        "w3": "SELECT * EXCLUDE (z), CAST(xor(z, z >> 31) >> 11 AS DOUBLE) * pow(2e0, -53) AS u FROM w2",
        "w4": f"SELECT symbol, date, draw, CAST({steps} AS DOUBLE) AS w FROM w3 WHERE u >= {_CDF[0]!r}::DOUBLE",
        "weighted": f"SELECT {columns}, draw, w FROM {rows} JOIN w4 USING (symbol, date)",
    }


def _with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("row_id", src.brand_no().cast("bigint") * 100000 + F.unix_date("date"))


def _bootstrap(spark, sf) -> DataFrame:
    return metrics.bootstrap_ci(_with_id(predictions(spark, sf)), id_col="row_id", n_bootstrap=DRAWS)


def _bootstrap_ic(spark, sf) -> DataFrame:
    return metrics.bootstrap_ic(_with_id(predictions(spark, sf)), id_col="row_id", n_bootstrap=DRAWS)


_DRAWN = """SELECT model, split, draw, sum(w * abs(y_pred - y_true)) / sum(w) AS mae, sqrt(sum(w * pow(y_pred - y_true, 2)) / sum(w)) AS rmse,
  100 * sum(w * abs((y_pred - y_true) / y_true)) FILTER (WHERE abs(y_true) > 1e-8) / NULLIF(sum(w) FILTER (WHERE abs(y_true) > 1e-8), 0) AS mape,
  sum(w * (sign(y_true) = sign(y_pred))::INT) / sum(w) AS directional_accuracy,
  CASE WHEN sqrt(greatest(sum(w * y_pred * y_pred) / sum(w) - pow(sum(w * y_pred) / sum(w), 2), 0)) > 1e-8 THEN (sum(w * y_pred) / sum(w)) / sqrt(sum(w * y_pred * y_pred) / sum(w) - pow(sum(w * y_pred) / sum(w), 2)) END AS sharpe_ratio
  FROM weighted WHERE w > 0 GROUP BY model, split, draw"""


# Ablation

PLAN = {"remove_return": ["simple_return"], "remove_tier2": ["momentum_5"]}


def _variants(spark, sf) -> DataFrame:
    return ablation.ablation_predictions(ready(spark, sf), list(X2), PLAN)


_VARIANTS = {
    "ls": _LS,
    "ols": _PREDICTIONS["ols"],
    "fits": """SELECT 'full_feature_set' AS name, b1, b2 FROM ols UNION ALL SELECT 'remove_return', 0, c2y / v2 FROM ls UNION ALL SELECT 'remove_tier2', c1y / v1, 0 FROM ls""",
    "var": f"""SELECT f.name, split, symbol, date, target AS y_true, my + o.b1 * (simple_return - m1) + o.b2 * (momentum_5 - m2) AS y_base, my + f.b1 * (simple_return - m1) + f.b2 * (momentum_5 - m2) AS y_pred
      FROM ready, ols o, fits f WHERE {_EVAL}""",
    "vm": _metric_sql("name, split", "var"),
    **_ranks_sql("name, split", "var"),
    "scores": "SELECT * FROM vm JOIN ic USING (name, split)",
    "delta": "SELECT f.*, f.mae - b.mae AS delta_mae, f.rmse - b.rmse AS delta_rmse, f.directional_accuracy - b.directional_accuracy AS delta_directional_accuracy FROM scores f JOIN scores b ON b.name = 'full_feature_set' AND b.split = f.split",
}


def _ridge_one(df, features):
    return baselines.fit_ridge(df, features, alphas=(1.0,), written=True)


_FACTORY = {
    "ls": _LS,
    "fits": """SELECT 'full_feature_set' AS name, ((c1y / sqrt(v1)) * (1 + 1e0 / n) - (c12 / sqrt(v1 * v2)) * (c2y / sqrt(v2))) / (pow(1 + 1e0 / n, 2) - pow(c12 / sqrt(v1 * v2), 2)) / sqrt(v1) AS b1,
      ((c2y / sqrt(v2)) * (1 + 1e0 / n) - (c12 / sqrt(v1 * v2)) * (c1y / sqrt(v1))) / (pow(1 + 1e0 / n, 2) - pow(c12 / sqrt(v1 * v2), 2)) / sqrt(v2) AS b2 FROM ls
      UNION ALL SELECT 'remove_return', 0, c2y / v2 / (1 + 1e0 / n) FROM ls UNION ALL SELECT 'remove_tier2', c1y / v1 / (1 + 1e0 / n), 0 FROM ls""",
    "var": f"""SELECT f.name, split, symbol, date, target AS y_true, my + o.b1 * (simple_return - m1) + o.b2 * (momentum_5 - m2) AS y_base, my + f.b1 * (simple_return - m1) + f.b2 * (momentum_5 - m2) AS y_pred
      FROM ready, ls, (SELECT b1, b2 FROM fits WHERE name = 'full_feature_set') o, fits f WHERE {_EVAL}""",
}


def _protocol() -> list[baselines.Baseline]:
    return [
        baselines.RandomWalk(),
        baselines.HistoricalMean(),
        baselines.LinearRegression(X2),
        baselines.LinearRegression(X2, alphas=baselines.ALPHAS),
    ]


def _fit_report(spark, sf) -> DataFrame:
    df, models = ready(spark, sf), _protocol()
    return baselines.fit_report([m.fit(df) for m in models], df)


def _r2() -> metrics.SumMetric:
    """One minus the share of the variance that the predictions leave."""
    y, p = F.col("y_true"), F.col("y_pred")
    return metrics.SumMetric(
        "r2", {"e2": (p - y) * (p - y), "y": y, "y2": y * y}, lambda m: 1.0 - m["e2"] / (m["y2"] - m["y"] * m["y"])
    )


def _ablated(spark, sf) -> DataFrame:
    return ablation.ablation_metrics(_variants(spark, sf))


MANIFEST = {"simple_return": 1, "close_ma20": 1, "normalized_close": 1, "bb_width": 2, "stoch_k": 2, "atr_14": 2, "market_regime": 3}


def _manifest(spark, sf):
    return reports.feature_manifest(_checked(spark, sf), MANIFEST)


_MANIFEST_NULLS = " + ".join(f"count(*) - count({c})" for c in MANIFEST)


def _stats(spark, sf):
    return reports.feature_stats(labelled(spark, sf), X)


_STATS = " UNION ALL ".join(
    f"SELECT split, '{c}' AS feature, count({c}) AS count, count(*) - count({c}) AS nan_count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, "
    f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75 FROM labelled GROUP BY split"
    for c in X
)
_SHIFTS = " UNION ALL ".join(
    f"SELECT '{a}_vs_{b}' AS pair, x.feature, 100 * (y.mean - x.mean) / abs(x.mean) AS mean_shift_pct, 100 * (y.std - x.std) / abs(x.std) AS std_shift_pct "
    f"FROM st x JOIN st y USING (feature) WHERE x.split = '{a}' AND y.split = '{b}'"
    for a, b in reports.PAIRS
)


def _report_file(spark, sf):
    path = sinks.scratch_path(spark, "cleaning-reports")
    sinks.write_report(cq._report(spark, sf), path, fmt="json")
    return spark.read.json(path)


def _split_files(spark, sf):
    path = sinks.scratch_path(spark, "splits")
    sinks.write_splits(labelled(spark, sf), path)
    return sinks.read_split(spark, path, "validation")


def _artifact(spark, sf):
    path = sinks.scratch_path(spark, "scalers")
    scale.save_artifact(scale.scaler_fit(ready(spark, sf), X), path, version="v1")
    return scale.scaler_stats(scale.load_artifact(spark, path, version="v1"), X)


_SCALER = " UNION ALL ".join(
    f"SELECT '*' AS scope, '{c}' AS feature, count(*) AS fit_rows, min(date) AS fit_start_date, max(date) AS fit_end_date, avg({c}) AS mean, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS scale FROM ready WHERE split = 'train'"
    for c in X
)
_SCALED = "SELECT r.symbol, r.date, r.split, " + ", ".join(
    f"(r.{c} - (SELECT mean FROM sc WHERE feature = '{c}')) / (SELECT scale FROM sc WHERE feature = '{c}') AS {c}" for c in X
) + " FROM ready r"


def _scaled(spark, sf):
    df = ready(spark, sf)
    return scale.scaler_apply(df, scale.scaler_fit(df, X), X)


METRIC_DIGITS = same("mae rmse mape directional_accuracy sharpe_ratio", 6)
_STAGED = {"temporal": "SELECT symbol, CAST(l_shipdate AS DATE) AS date FROM (SELECT p_brand AS symbol, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey)"}


def _trade_rows(spark, sf):
    """Every trade of a brand: repeated dates and an ingest order that is not the date order."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_brand").alias("symbol"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("symbol", F.to_date("l_shipdate").alias("date"))


ENTRIES: dict[str, Entry] = {
    "drop_warmup": entry(ready, _sql("SELECT * FROM ready"), digits=same([*X, "target"], 6)),
    "nan_inf_summary": entry(
        lambda spark, sf: quality.nan_inf_summary(_checked(spark, sf), CHECKED, expected_nan_rows=WARMUP),
        sql(f"SELECT *, nan_count <= {WARMUP} AS nan_ok FROM nans", "base", **_CHECKED, nans=_VALID["nans"]),
        keys=("symbol", "feature", "nan_count", "inf_count", "nan_ok"),
    ),
    "range_check": entry(
        lambda spark, sf: quality.range_check(_checked(spark, sf), CHECKED),
        sql("SELECT * FROM ranges", "base", **_CHECKED, ranges=_VALID["ranges"]),
        keys=("symbol", "feature", "range_ok", "extreme"),
        digits=same("min_value max_value"),
    ),
    "jump_check": entry(
        lambda spark, sf: quality.jump_check(_checked(spark, sf), CHECKED),
        sql("SELECT * FROM jumps", "base", **_CHECKED, **_JUMP),
        keys=("symbol", "feature", "n", "large_jumps", "jump_warning"),
    ),
    "temporal_alignment": entry(
        lambda spark, sf: quality.temporal_alignment(_trade_rows(spark, sf)),
        sql(
            "SELECT symbol, CAST(sum(n - 1) AS BIGINT) AS duplicate_dates, sum(n - 1) = 0 AS alignment_ok FROM (SELECT symbol, date, count(*) AS n FROM temporal GROUP BY ALL) GROUP BY symbol",
            **_STAGED,
        ),
        keys=("symbol", "duplicate_dates", "alignment_ok"),
    ),
    "feature_validation": entry(
        _validation,
        sql("SELECT * FROM validation", "base", **_CHECKED, **_VALID),
        keys="symbol nan_values infinite_values value_ranges causality temporal_alignment is_valid".split(),
    ),
    "feature_validation_totals": entry(
        lambda spark, sf: quality.validation_totals(_validation(spark, sf)),
        sql(
            "SELECT count(*) AS total_symbols, count(*) FILTER (WHERE is_valid) AS symbols_passed, count(*) FILTER (WHERE NOT is_valid) AS symbols_failed FROM validation",
            "base",
            **_CHECKED,
            **_VALID,
        ),
        keys=("total_symbols", "symbols_passed", "symbols_failed"),
    ),
    "module_validators": entry(
        lambda spark, sf: quality.module_validators(_checked(spark, sf).select("symbol", *CHECKED)),
        sql(" UNION ALL ".join(_rule_sql(c) for c in _RULES), "base", **_CHECKED),
        keys=("symbol", "feature", "out_of_range", "passed"),
    ),
    "chrono_split": entry(
        lambda spark, sf: split.chrono_split(src.bars(spark, sf)),
        _sql("SELECT symbol, date, split FROM labelled"),
        keys=("symbol", "date", "split"),
    ),
    "split_cutoffs": entry(
        lambda spark, sf: split.split_cutoffs(src.bars(spark, sf)),
        _sql("SELECT * FROM cut"),
        keys=tuple(f"{s}_{e}_date" for s in ("train", "val", "test") for e in ("start", "end")),
    ),
    "split_metadata": entry(
        lambda spark, sf: split.split_metadata(split.chrono_split(src.bars(spark, sf))),
        _sql(
            "SELECT split, symbol, count(*) AS row_count, min(date) AS start_date, max(date) AS end_date FROM labelled GROUP BY split, symbol UNION ALL SELECT split, 'ALL', count(*), min(date), max(date) FROM labelled GROUP BY split"
        ),
        keys=("split", "symbol", "row_count", "start_date", "end_date"),
    ),
    "split_verify": entry(
        lambda spark, sf: split.split_verify(_shifted(spark, sf)),
        _sql(
            "SELECT symbol, count(*) FILTER (WHERE k > 1) AS shared_dates, count(*) FILTER (WHERE k > 1) = 0 AND max(date) FILTER (WHERE tr) < min(date) FILTER (WHERE va) AND max(date) FILTER (WHERE va) < min(date) FILTER (WHERE te) AS no_leakage "
            "FROM (SELECT symbol, date, count(DISTINCT split) AS k, bool_or(split = 'train') AS tr, bool_or(split = 'validation') AS va, bool_or(split = 'test') AS te FROM shifted GROUP BY symbol, date) GROUP BY symbol",
            shifted="SELECT symbol, date, split FROM labelled UNION ALL SELECT symbol, date, 'train' FROM labelled WHERE split = 'validation' AND CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS BIGINT) % 6 = 0 AND dayofmonth(date) = 5",
        ),
        keys=("symbol", "shared_dates", "no_leakage"),
    ),
    "split_sink": entry(
        _split_files,
        _sql("SELECT * FROM labelled WHERE split = 'validation'"),
        keys=("symbol", "date", "split"),
        digits={"close": 8},
    ),
    "scaler_fit": entry(
        lambda spark, sf: scale.scaler_stats(scale.scaler_fit(ready(spark, sf), X), X),
        _sql(_SCALER),
        keys=("scope", "feature", "fit_rows", "fit_start_date", "fit_end_date"),
        digits=same("mean scale", 8),
    ),
    "scaler_fit_symbol": entry(
        lambda spark, sf: scale.scaler_stats(scale.scaler_fit(ready(spark, sf), X, scope="symbol"), X),
        _sql(_SCALER.replace("'*' AS scope", "symbol AS scope").replace("split = 'train'", "split = 'train' GROUP BY symbol")),
        keys=("scope", "feature", "fit_rows", "fit_start_date", "fit_end_date"),
        digits=same("mean scale", 8),
    ),
    "scaler_apply": entry(_scaled, _sql(_SCALED, sc=_SCALER), keys=("symbol", "date", "split"), digits=same(X, 5)),
    "broadcast_scaler": entry(
        lambda spark, sf: _scaled(spark, sf).groupBy("split").agg(
            *[a for c in X for a in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))]
        ),
        _sql(
            "SELECT split, " + ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in X) + " FROM scaled GROUP BY split",
            sc=_SCALER,
            scaled=_SCALED,
        ),
        keys=("split",),
        digits=same([f"{k}_{c}" for c in X for k in ("mean", "std")], 6),
    ),
    "scaler_verify": entry(
        lambda spark, sf: scale.scaler_verify(ready(spark, sf), scale.scaler_fit(ready(spark, sf), X), X),
        _sql("SELECT split, count(*) AS row_count, split = 'train' AS same_statistics, split = 'train' AS same_rows, true AS passed FROM ready GROUP BY split"),
        keys=("split", "row_count", "same_statistics", "same_rows", "passed"),
    ),
    "artifact_store": entry(
        _artifact,
        _sql(_SCALER),
        keys=("scope", "feature", "fit_rows", "fit_start_date", "fit_end_date"),
        digits=same("mean scale", 8),
    ),
    "leak_artifact": entry(
        lambda spark, sf: leakage.leak_artifact(_overlapping(spark, sf), fit_data_source="validation", fit_date="2002-01-01"),
        _sql(
            "SELECT * FROM (SELECT 'temporal_overlap' AS violation_type, 'CRITICAL' AS severity, 'train/validation' AS affected, CAST(1 AS BIGINT) AS violations, t1 >= v0 AS bad FROM rg "
            "UNION ALL SELECT 'temporal_overlap', 'CRITICAL', 'validation/test', 1, v1 >= s0 FROM rg UNION ALL SELECT 'artifact_fit_leakage', 'CRITICAL', 'validation', 1, true FROM rg "
            "UNION ALL SELECT 'artifact_date_mismatch', 'ERROR', '2002-01-01', 1, DATE '2002-01-01' NOT BETWEEN t0 AND t1 FROM rg) WHERE bad",
            over="SELECT date, CASE WHEN split = 'validation' AND dayofmonth(date) = 3 THEN 'train' ELSE split END AS split FROM labelled",
            rg="SELECT min(date) FILTER (WHERE split = 'train') AS t0, max(date) FILTER (WHERE split = 'train') AS t1, min(date) FILTER (WHERE split = 'validation') AS v0, max(date) FILTER (WHERE split = 'validation') AS v1, min(date) FILTER (WHERE split = 'test') AS s0 FROM over",
        ),
        keys=VIOLATION,
    ),
    "leak_lookahead": entry(
        lambda spark, sf: leakage.leak_lookahead(_checked(spark, sf), CHECKED, lookback_windows={"momentum_20": 20, "broken": 0}),
        sql(
            "SELECT 'excessive_nan' AS violation_type, 'WARNING' AS severity, 'features' AS affected, nulls AS violations FROM t WHERE nulls > n * 0.1 UNION ALL SELECT 'invalid_lookback', 'ERROR', 'broken', 1 FROM t",
            "base",
            **_CHECKED,
            t="SELECT count(*) AS n, " + " + ".join(f"count(*) - count({c})" for c in CHECKED) + " AS nulls FROM checked",
        ),
        keys=VIOLATION,
    ),
    "leak_split": entry(_leak_split, sql("SELECT * FROM violations", **_ROWS), keys=VIOLATION),
    "leak_cv": entry(
        lambda spark, sf: leakage.leak_cv(_folds(spark, sf)),
        "SELECT 'cv_fold_overlap' AS violation_type, 'CRITICAL' AS severity, 'fold 3' AS affected, count(*) AS violations FROM orders WHERE o_custkey % 50 = 0 AND o_orderkey % 5 <> 3",
        keys=VIOLATION,
    ),
    "leak_report": entry(
        lambda spark, sf: leakage.leak_report(_leak_split(spark, sf).unionByName(leakage.leak_cv(_folds(spark, sf)))),
        sql(
            "SELECT count(*) AS total_violations, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings, bool_or(severity = 'CRITICAL') AS leakage_detected "
            "FROM (SELECT severity FROM violations UNION ALL SELECT 'CRITICAL' WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey % 50 = 0 AND o_orderkey % 5 <> 3))",
            **_ROWS,
        ),
        keys=("total_violations", "critical", "errors", "warnings", "leakage_detected"),
    ),
    "set_union_dates": entry(
        lambda spark, sf: leakage.union_dates(
            src.bars(spark, sf), spark.read.parquet(f"{sf}/orders.parquet").select(F.to_date("o_orderdate").alias("date"))
        ),
        sql("SELECT date FROM bars UNION SELECT CAST(o_orderdate AS DATE) FROM orders", "bars"),
        keys=("date",),
    ),
    "set_intersect_splits": entry(
        lambda spark, sf: leakage.shared_rows(
            _split_rows(spark, sf).where("split = 'train'"), _split_rows(spark, sf).where("split = 'validation'")
        ),
        sql("SELECT row_id FROM split_rows WHERE split = 'train' INTERSECT SELECT row_id FROM split_rows WHERE split = 'validation'", split_rows=_ROWS["split_rows"]),
        keys=("row_id",),
    ),
    "set_except_uncovered": entry(
        lambda spark, sf: leakage.uncovered_rows(
            spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("row_id")), _split_rows(spark, sf)
        ),
        sql("SELECT o_orderkey AS row_id FROM orders EXCEPT SELECT row_id FROM split_rows", split_rows=_ROWS["split_rows"]),
        keys=("row_id",),
    ),
    "xy_align_check": entry(
        lambda spark, sf: baselines.xy_mismatches(ready(spark, sf), labelled(spark, sf).where("momentum_5 > 0")),
        _sql(
            "SELECT count(*) FILTER (WHERE y IS NULL) AS without_target, count(*) FILTER (WHERE x IS NULL) AS without_features FROM (SELECT symbol, date, 1 AS x FROM ready) a FULL JOIN (SELECT symbol, date, 1 AS y FROM labelled WHERE momentum_5 > 0) b USING (symbol, date)"
        ),
        keys=("without_target", "without_features"),
    ),
    "random_walk": entry(
        lambda spark, sf: baselines.random_walk(ready(spark, sf)),
        _pred_sql("SELECT * FROM pred WHERE model = 'random_walk'"),
        keys=("model", "split", "symbol", "date"),
        digits=same("y_true y_pred", 8),
    ),
    "historical_mean": entry(
        lambda spark, sf: baselines.historical_mean(ready(spark, sf)),
        _pred_sql("SELECT * FROM pred WHERE model = 'historical_mean'"),
        keys=("model", "split", "symbol", "date"),
        digits=same("y_true y_pred", 8),
    ),
    "linear_regression": entry(
        lambda spark, sf: baselines.fit_linear(ready(spark, sf), X2).predict(ready(spark, sf)),
        _pred_sql("SELECT * FROM pred WHERE model = 'linear_regression'"),
        keys=("model", "split", "symbol", "date"),
        digits=same("y_true y_pred", 6),
    ),
    "linear_coefficients": entry(
        lambda spark, sf: baselines.fit_linear(ready(spark, sf), X2).table(spark),
        _pred_sql("SELECT 'intercept' AS feature, my - b1 * m1 - b2 * m2 AS coefficient FROM ols UNION ALL SELECT 'simple_return', b1 FROM ols UNION ALL SELECT 'momentum_5', b2 FROM ols"),
        keys=("feature",),
        digits={"coefficient": 7},
    ),
    "ridge_regression": entry(
        lambda spark, sf: baselines.fit_ridge(ready(spark, sf), X2).predict(ready(spark, sf)),
        _pred_sql("SELECT * FROM pred WHERE model = 'ridge_regression'"),
        keys=("model", "split", "symbol", "date"),
        digits=same("y_true y_pred", 6),
    ),
    "arima_111": entry(
        lambda spark, sf: baselines.arima_111(ready(spark, sf)),
        keys=("model", "split", "symbol", "date"),
        digits=same("y_true y_pred", 6),
    ),
    "baseline_suite": entry(
        lambda spark, sf: baselines.baseline_scores(baselines.baseline_suite(ready(spark, sf), tier1=X2, features=X)),
        keys=("model", "split", "n"),
        digits=same("mae rmse directional_accuracy"),
    ),
    "baseline_scores": entry(
        lambda spark, sf: baselines.baseline_scores(predictions(spark, sf)),
        _pred_sql(_metric_sql("model, split")),
        keys=("model", "split", "n"),
        digits=same("mae rmse directional_accuracy"),
    ),
    "best_baseline": entry(
        lambda spark, sf: baselines.best_baseline(baselines.baseline_scores(predictions(spark, sf))),
        _pred_sql("SELECT model, mae FROM m WHERE split = 'test' ORDER BY mae, model LIMIT 1", m=_metric_sql("model, split")),
        keys=("model",),
        digits={"mae": 6},
    ),
    "point_metrics": entry(
        lambda spark, sf: metrics.point_metrics(predictions(spark, sf)),
        _pred_sql(_metric_sql("model, split")),
        keys=("model", "split", "n", "zero_actuals_excluded"),
        digits={**METRIC_DIGITS, "mape": 4},
    ),
    "information_coefficient": entry(
        lambda spark, sf: metrics.information_coefficient(predictions(spark, sf)),
        _pred_sql("SELECT * FROM ic", **_ranks_sql("model, split")),
        keys=("model", "split"),
        digits={"information_coefficient": 6},
    ),
    "metric_bundle": entry(
        lambda spark, sf: metrics.metric_bundle(predictions(spark, sf)),
        _pred_sql("SELECT * FROM m JOIN ic USING (model, split)", m=_metric_sql("model, split"), **_ranks_sql("model, split")),
        keys=("model", "split", "n"),
        digits={**METRIC_DIGITS, "mape": 4, "information_coefficient": 6},
    ),
    "bootstrap_ci": entry(
        _bootstrap,
        _pred_sql(
            "SELECT * FROM ci JOIN pt USING (model, split, metric)",
            **_weights("known", "model, split, y_true, y_pred"),
            drawn=_DRAWN,
            ci=" UNION ALL ".join(
                f"SELECT model, split, '{m}' AS metric, quantile_cont({m}, 0.025) AS ci_lower, quantile_cont({m}, 0.975) AS ci_upper FROM drawn GROUP BY model, split"
                for m in metrics.INTERVALS
            ),
            m=_metric_sql("model, split"),
            pt=" UNION ALL ".join(f"SELECT model, split, '{c}' AS metric, {c} AS value FROM m" for c in metrics.INTERVALS),
        ),
        keys=("model", "split", "metric"),
        digits=same("value ci_lower ci_upper", 4),
    ),
    # A thousand weighted sorts take SQL too long; tests check every draw.
    "bootstrap_ic": entry(_bootstrap_ic, keys=("model", "split"), digits=same("ci_lower ci_upper", 5)),
    "per_symbol_eval": entry(
        lambda spark, sf: metrics.point_metrics(predictions(spark, sf), by=("model", "split", "symbol")),
        _pred_sql(_metric_sql("model, split, symbol")),
        keys=("model", "split", "symbol", "n"),
        digits=same("mae rmse directional_accuracy"),
    ),
    "per_month_eval": entry(
        lambda spark, sf: metrics.point_metrics(
            predictions(spark, sf).withColumn("month", F.date_format("date", "yyyy-MM")), by=("model", "month")
        ),
        _pred_sql(_metric_sql("model, month", "mo"), mo="SELECT *, strftime(date, '%Y-%m') AS month FROM known"),
        keys=("model", "month", "n"),
        digits=same("mae rmse directional_accuracy"),
    ),
    "ablation_run": entry(
        _ablated,
        _sql("SELECT * FROM delta", **_VARIANTS),
        keys=("name", "split", "n"),
        digits=same("mae rmse directional_accuracy sharpe_ratio information_coefficient delta_mae delta_rmse delta_directional_accuracy", 5),
    ),
    "ablation_model_factory": entry(
        lambda spark, sf: ablation.ablation_predictions(ready(spark, sf), list(X2), PLAN, model_factory=_ridge_one),
        _sql("SELECT * FROM var", **_FACTORY),
        keys=("name", "split", "symbol", "date"),
        digits=same("y_true y_base y_pred", 7),
    ),
    "baseline_protocol": entry(
        lambda spark, sf: baselines.fit_predict(_protocol(), ready(spark, sf)),
        _pred_sql("SELECT * FROM pred"),
        keys=("model", "split", "symbol", "date"),
        digits=same("y_true y_pred", 7),
    ),
    "baseline_fit_report": entry(
        lambda spark, sf: _fit_report(spark, sf).withColumn(
            "best_alpha", F.get_json_object("hyperparameters", "$.best_alpha").cast("double")
        ),
        _pred_sql(
            "SELECT m.model, CASE WHEN m.model = 'ridge_regression' THEN (SELECT alpha FROM rbest) END AS best_alpha, s.* FROM (VALUES ('random_walk'), ('historical_mean'), ('linear_regression'), ('ridge_regression')) m(model), "
            "(SELECT " + ", ".join(
                f"min(date) FILTER (WHERE split = '{s}') AS {s}_start_date, max(date) FILTER (WHERE split = '{s}') AS {s}_end_date, count(*) FILTER (WHERE split = '{s}') AS {s}_rows"
                for s in ("train", "validation")
            ) + " FROM ready) s"
        ),
        keys=("model", *[f"{s}_{c}" for s in ("train", "validation") for c in ("start_date", "end_date", "rows")]),
        digits={"best_alpha": 6},
    ),
    "bootstrap_metric_fn": entry(
        lambda spark, sf: metrics.bootstrap_metric(_with_id(predictions(spark, sf)), _r2(), id_col="row_id", n_bootstrap=DRAWS),
        _pred_sql(
            "SELECT model, split, 'r2' AS metric, (SELECT 1 - avg(pow(k.y_pred - k.y_true, 2)) / var_pop(k.y_true) FROM known k WHERE k.model = r.model AND k.split = r.split) AS value, "
            "quantile_cont(v, 0.025) AS ci_lower, quantile_cont(v, 0.975) AS ci_upper, count(v) AS draws FROM r GROUP BY model, split",
            **_weights("known", "model, split, y_true, y_pred"),
            r="SELECT model, split, draw, 1 - (sum(w * pow(y_pred - y_true, 2)) / sum(w)) / (sum(w * y_true * y_true) / sum(w) - pow(sum(w * y_true) / sum(w), 2)) AS v FROM weighted WHERE w > 0 GROUP BY model, split, draw",
        ),
        keys=("model", "split", "metric", "draws"),
        digits=same("value ci_lower ci_upper", 4),
    ),
    "ablation_default_plan": entry(
        lambda spark, sf: ablation.ablation_metrics(
            ablation.ablation_predictions(ready(spark, sf), list(X), ablation.default_plan(list(X)))
        ),
        keys=("name", "split", "n"),
        digits=same("mae rmse delta_mae delta_rmse"),
    ),
    "paired_ttest": entry(
        lambda spark, sf: ablation.paired_stats(_variants(spark, sf)).where("name <> 'full_feature_set'"),
        _sql(
            "SELECT name, split, count(*) AS n, avg(d) AS mean_difference, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t_statistic FROM dd GROUP BY name, split",
            **_VARIANTS,
            dd="SELECT *, abs(y_true - y_base) - abs(y_true - y_pred) AS d FROM var WHERE name <> 'full_feature_set'",
        ),
        keys=("name", "split", "n"),
        digits={"mean_difference": 7, "t_statistic": 4},
    ),
    "paired_ttest_p": entry(
        lambda spark, sf: ablation.paired_ttest(_variants(spark, sf)),
        keys=("name", "split", "n"),
        digits={"p_value": 6},
    ),
    "ablation_summary": entry(
        lambda spark, sf: ablation.ablation_summary(_ablated(spark, sf)),
        _sql(
            "SELECT name AS ablation_name, max(mae) FILTER (WHERE split = 'validation') AS validation_mae, max(rmse) FILTER (WHERE split = 'validation') AS validation_rmse, max(mae) FILTER (WHERE split = 'test') AS test_mae, max(rmse) FILTER (WHERE split = 'test') AS test_rmse, "
            "max(delta_mae) FILTER (WHERE split = 'test') AS delta_test_mae, max(delta_rmse) FILTER (WHERE split = 'test') AS delta_test_rmse FROM delta WHERE name <> 'full_feature_set' GROUP BY name",
            **_VARIANTS,
        ),
        keys=("ablation_name",),
        digits=same("validation_mae validation_rmse test_mae test_rmse delta_test_mae delta_test_rmse"),
    ),
    "tier_contributions": entry(
        lambda spark, sf: ablation.tier_contributions(_ablated(spark, sf)),
        _sql(
            "SELECT CASE name WHEN 'remove_return' THEN 'Tier-1' ELSE 'Tier-2' END AS tier, abs(delta_mae) AS contribution FROM delta WHERE split = 'test' AND name <> 'full_feature_set'",
            **_VARIANTS,
        ),
        keys=("tier",),
        digits={"contribution": 6},
    ),
    "ablation_heat_map": entry(
        lambda spark, sf: ablation.heat_map(_ablated(spark, sf)),
        _sql(
            "SELECT name, 'MAE Delta' AS metric, delta_mae AS delta FROM h UNION ALL SELECT name, 'RMSE Delta', delta_rmse FROM h UNION ALL SELECT name, 'Dir.Acc. Delta', delta_directional_accuracy FROM h",
            **_VARIANTS,
            h="SELECT * FROM delta WHERE split = 'test' AND name <> 'full_feature_set'",
        ),
        keys=("name", "metric"),
        digits={"delta": 6},
    ),
    "feature_stats": entry(
        _stats,
        _sql(_STATS),
        keys=("split", "feature", "count", "nan_count"),
        digits=same("mean std min max q25 median q75", 7),
    ),
    "distribution_shift": entry(
        lambda spark, sf: reports.distribution_shift(_stats(spark, sf)),
        _sql("SELECT *, abs(mean_shift_pct) > 10 OR abs(std_shift_pct) > 10 AS flagged FROM sh", st=_STATS, sh=_SHIFTS),
        keys=("pair", "feature", "flagged"),
        digits=same("mean_shift_pct std_shift_pct", 4),
    ),
    "feature_manifest": entry(
        _manifest,
        sql(f"SELECT symbol, count(*) AS row_count, {len(MANIFEST)} AS feature_count, {_MANIFEST_NULLS} AS total_nan_count FROM checked GROUP BY symbol", "base", **_CHECKED),
        keys=("symbol", "row_count", "feature_count", "total_nan_count"),
    ),
    "tier_counts": entry(
        lambda spark, sf: reports.tier_counts(_manifest(spark, sf)),
        sql(
            "SELECT tier, max(n) AS features FROM (SELECT symbol, tier, count(*) AS n FROM (SELECT DISTINCT symbol FROM bars), (VALUES "
            + ", ".join(f"('{c}', {t})" for c, t in MANIFEST.items())
            + ") m(feature, tier) GROUP BY symbol, tier) GROUP BY tier",
            "bars",
        ),
        keys=("tier", "features"),
    ),
    "sink_reports": entry(
        _report_file,
        cq._report_sql("SELECT * FROM report"),
        keys=("symbol", "raw_data_rows", "rows_excluded", "forward_fills_applied", "quality_status"),
        digits={"completeness_percent": 2},
    ),
}


def _shifted(spark, sf) -> DataFrame:
    """Labelled bars of which some validation days of every sixth brand are in train as well."""
    base = split.chrono_split(src.bars(spark, sf)).select("symbol", "date", "split")
    extra = base.where((F.col("split") == "validation") & (src.brand_no() % 6 == 0) & (F.dayofmonth("date") == 5))
    return base.unionByName(extra.withColumn("split", F.lit("train")))


def _overlapping(spark, sf) -> DataFrame:
    """Labelled bars with one validation day a month moved into train."""
    moved = (F.col("split") == "validation") & (F.dayofmonth("date") == 3)
    return split.chrono_split(src.bars(spark, sf)).withColumn("split", F.when(moved, "train").otherwise(F.col("split")))
