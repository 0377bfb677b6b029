"""Quality checks on bars and on feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.blocks import carried, in_slices
from barloom.functions.guards import broadcast_if_small
from barloom.functions.rolling import before, series_window, upto
from barloom.operators.clean import is_ordered
from barloom.sources.bars import OHLCV
from barloom.sources.sinks import materialize


def _cells(columns: Sequence[str], fields) -> Column:
    """Array with one struct per column, to be turned into rows."""
    return F.array(*[F.struct(F.lit(c).alias("feature"), *fields(c)) for c in columns])


def column_stats(df: DataFrame, *, columns: Sequence[str] = OHLCV) -> DataFrame:
    """Per symbol and column: count, min, max, mean, median, sample std and null count."""
    aggs = []
    for c in columns:
        aggs += [
            F.count(c).alias(f"{c}_n"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
            F.avg(c).alias(f"{c}_mean"),
            F.percentile(c, 0.5).alias(f"{c}_median"),
            F.stddev_samp(c).alias(f"{c}_std"),
            F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"),
        ]
    names = {"n": "count", "min": "min", "max": "max", "mean": "mean", "median": "median", "std": "std", "nulls": "null_count"}
    wide = df.groupBy("symbol").agg(*aggs)
    return wide.select(
        "symbol", F.inline(_cells(columns, lambda c: [F.col(f"{c}_{k}").alias(v) for k, v in names.items()]))
    ).withColumnRenamed("feature", "column")


def stats_check(df: DataFrame, *, columns: Sequence[str] = OHLCV) -> DataFrame:
    """Per symbol: names of columns whose mean is infinite, whether volume goes below 0, and the verdict."""
    infinite = [F.when(F.abs(F.avg(c)) == float("inf"), F.lit(c)) for c in columns]
    negative = F.coalesce(F.min("volume") < 0, F.lit(False))
    return (
        df.groupBy("symbol")
        .agg(F.array_compact(F.array(*infinite)).alias("infinite_mean"), negative.alias("negative_volume"))
        .withColumn("stats_ok", (F.size("infinite_mean") == 0) & ~F.col("negative_volume"))
    )


def quality_report(
    df: DataFrame,
    *,
    min_trading_days: int = 2500,
    min_completeness: float = 0.99,
    stasis_days: int = 5,
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per symbol: row count, price order, statistics and stasis checks, and their conjunction.

    ``also`` adds sums of further columns, and turns on the date range, in the same pass.

    Equal-close runs are pre-grouped on (symbol, run), which the distribution by symbol
    already satisfies, so the whole report costs one exchange.
    """
    w = series_window()
    moved = F.coalesce(F.col("close") != F.last("close", True).over(before(w)), F.lit(False)).cast("int")
    runs = df.withColumn("_moved", moved).withColumn("_run", F.sum("_moved").over(upto(w)))
    per_run = runs.groupBy("symbol", "_run").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("close").alias("known"),
        F.count_if(is_ordered()).alias("valid"),
        F.min("volume").alias("min_volume"),
        *[F.sum(c).alias(f"sum_{c}") for c in OHLCV],
        *[F.sum(e).alias(n) for n, e in (also or {}).items()],
        F.min("date").alias("_first"),
        F.max("date").alias("_last"),
    )
    infinite = F.lit(False)
    for c in OHLCV:
        infinite = infinite | F.coalesce(F.abs(F.sum(f"sum_{c}")) == float("inf"), F.lit(False))
    report = per_run.groupBy("symbol").agg(
        F.sum("rows").alias("total_rows"),
        F.sum("valid").alias("valid_bars"),
        F.count_if(F.col("known") >= stasis_days).alias("stasis_runs"),
        (~infinite & ~F.coalesce(F.min("min_volume") < 0, F.lit(False))).alias("stats_ok"),
        *([F.sum(n).alias(n) for n in also] + [F.min("_first").alias("start_date"), F.max("_last").alias("end_date")] if also else []),
    )
    return report.withColumns(
        {
            "enough_days": F.col("total_rows") >= min_trading_days,
            "ordering_pct": F.col("valid_bars") / F.col("total_rows"),
            "stasis_ok": F.col("stasis_runs") == 0,
        }
    ).withColumn("ordering_ok", F.col("ordering_pct") >= min_completeness).withColumn(
        "overall_pass", F.col("enough_days") & F.col("ordering_ok") & F.col("stats_ok") & F.col("stasis_ok")
    )


def validation_summary(quality: DataFrame, excluded: DataFrame) -> DataFrame:
    """Totals over the quality reports and the exclusion list."""
    rows = quality.select(F.col("overall_pass").alias("ok"), F.lit(False).alias("out")).unionByName(
        excluded.select(F.lit(None).cast("boolean").alias("ok"), F.lit(True).alias("out"))
    )
    return rows.agg(
        F.count(F.lit(1)).alias("total_symbols"),
        F.count_if(F.col("ok")).alias("symbols_passed"),
        F.count_if(F.col("out")).alias("symbols_excluded"),
        F.count_if(~F.col("ok")).alias("symbols_manual_review"),
    )


def review_flags(quality: DataFrame) -> DataFrame:
    """Completeness in percent per symbol and why it needs a manual review, if it does."""
    failed = F.array_compact(
        F.array(
            *[
                F.when(~F.col(c), F.lit(name))
                for c, name in (
                    ("enough_days", "min_trading_days"),
                    ("ordering_ok", "ohlc_relationships"),
                    ("stats_ok", "statistics"),
                    ("stasis_ok", "price_stasis"),
                )
            ]
        )
    )
    return quality.select(
        "symbol",
        F.col("overall_pass").alias("passed"),
        F.round(F.col("ordering_pct") * 100, 2).alias("completeness_percent"),
        F.array_join(failed, ",").alias("failed_checks"),
    )


def exclude_symbols(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Bars of the symbols that are not on the exclusion list."""
    return df.join(broadcast_if_small(excluded.select("symbol").distinct()), "symbol", "left_anti")


def exclusion_summary(excluded: DataFrame) -> DataFrame:
    """Symbols per exclusion reason."""
    return excluded.groupBy("reason").agg(
        F.countDistinct("symbol").alias("symbols"), F.array_sort(F.collect_set("symbol")).alias("symbol_list")
    )


def log_price_guard(df: DataFrame) -> DataFrame:
    """Log close of the symbols whose closes are all known, finite and positive; others are left out."""
    bad = ~F.coalesce((F.col("close") > 0) & (F.col("close") < float("inf")), F.lit(False))
    any_bad = F.max(bad).over(Window.partitionBy("symbol"))
    return df.withColumn("_bad", any_bad).where(~F.col("_bad")).withColumn("log_close", F.ln("close")).drop("_bad")


def quarantined_symbols(df: DataFrame) -> DataFrame:
    """Symbols with closes that have no logarithm, and how many."""
    bad = ~F.coalesce((F.col("close") > 0) & (F.col("close") < float("inf")), F.lit(False))
    return df.groupBy("symbol").agg(F.count_if(bad).alias("bad_closes")).where("bad_closes > 0")


def drop_warmup(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows on which every feature is known."""
    return df.na.drop(subset=list(features))


# Feature tables


def nan_inf_summary(
    df: DataFrame, features: Sequence[str], *, by: Sequence[str] = ("symbol",), expected_nan_rows: int = 0
) -> DataFrame:
    """Nulls and infinities per feature, and whether there are more nulls than the warm-up explains."""
    aggs = []
    for c in features:
        x = F.col(c).cast("double")
        aggs += [
            F.count_if(x.isNull() | F.isnan(x)).alias(f"{c}_nan"),
            F.count_if(F.abs(x) == float("inf")).alias(f"{c}_inf"),
        ]
    wide = df.groupBy(*by).agg(*aggs)
    cells = _cells(features, lambda c: [F.col(f"{c}_nan").alias("nan_count"), F.col(f"{c}_inf").alias("inf_count")])
    return wide.select(*by, F.inline(cells)).withColumn("nan_ok", F.col("nan_count") <= expected_nan_rows)


# Allowed range by part of the feature name; the first match counts.
NAME_RANGES: tuple[tuple[tuple[str, ...], float | None, float | None], ...] = (
    (("rsi",), 0.0, 100.0),
    (("stoch", "%k", "%d"), 0.0, 100.0),
    (("correlation", "corr"), -1.0, 1.0),
    (("volatility", "std"), 0.0, None),
)


def name_range(feature: str) -> tuple[float | None, float | None]:
    low = feature.lower()
    for parts, lo, hi in NAME_RANGES:
        if any(p in low for p in parts):
            return lo, hi
    return None, None


def range_check(df: DataFrame, features: Sequence[str], *, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Range of each feature against the one its name implies; extreme returns only warn."""
    wide = df.groupBy(*by).agg(
        *[a for c in features for a in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    )

    def fields(c: str) -> list[Column]:
        lo, hi = name_range(c)
        a, b = F.col(f"{c}_min").cast("double"), F.col(f"{c}_max").cast("double")
        out = F.lit(False)
        if lo is not None:
            out = out | F.coalesce(a < lo, F.lit(False))
        if hi is not None:
            out = out | F.coalesce(b > hi, F.lit(False))
        is_return = "return" in c.lower() and (lo, hi) == (None, None)
        extreme = F.coalesce(F.greatest(F.abs(a), F.abs(b)) > 5.0, F.lit(False)) if is_return else F.lit(False)
        return [a.alias("min_value"), b.alias("max_value"), (~out).alias("range_ok"), extreme.alias("extreme")]

    return wide.select(*by, F.inline(_cells(features, fields)))


def jump_check(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per symbol and feature: steps of the absolute value beyond five times their 95th percentile.

    Warns above 5% of the values. Features with fewer than 100 values, and returns, are not judged.
    """
    named = [c for c in features if "return" not in c.lower()]
    w = series_window()
    steps = df.select(
        "symbol",
        "date",
        *named,
        *[
            (F.abs(c) - F.last(F.abs(F.col(c)), True).over(before(w))).alias(f"_d_{c}")
            for c in named
        ],
    ).withColumns({f"_d_{c}": F.when(F.col(c).isNotNull(), F.col(f"_d_{c}")) for c in named})
    whole = Window.partitionBy("symbol")
    cut = steps.withColumns({f"_q_{c}": F.percentile(f"_d_{c}", 0.95).over(whole) for c in named})
    wide = cut.groupBy("symbol").agg(
        *[
            a
            for c in named
            for a in (
                F.count(c).alias(f"{c}_n"),
                F.count_if(F.col(f"_d_{c}") > 5.0 * F.col(f"_q_{c}")).alias(f"{c}_jumps"),
            )
        ]
    )
    cells = _cells(named, lambda c: [F.col(f"{c}_n").alias("n"), F.col(f"{c}_jumps").alias("large_jumps")])
    return wide.select("symbol", F.inline(cells)).withColumn(
        "jump_warning", (F.col("n") >= 100) & (F.col("large_jumps") > 0.05 * F.col("n"))
    )


def temporal_alignment(df: DataFrame, *, seq_col: str | None = None) -> DataFrame:
    """Per symbol: duplicate dates, and rows out of order in ingest sequence (when there is one).

    The sequence is sorted over all tasks; a symbol may have any number of rows.
    """
    if seq_col is None:
        marked = df.select("symbol", "date", F.lit(0).alias("_late"))
    else:
        rows = in_slices(df.select("symbol", "date", seq_col), symbol_col="symbol", order_col=seq_col)
        # A slice of the sequence starts after the last date of the slice before.
        ends = materialize(rows.groupBy("symbol", "_slice").agg(F.max_by("date", "_at").alias("_end")), "slice-ends")
        ends = carried(ends, "_end", "_before", symbol_col="symbol", last=True)
        near = F.lag("date").over(Window.partitionBy("symbol", "_slice").orderBy("_at"))
        late = F.coalesce(F.col("date") < F.coalesce(near, F.col("_before")), F.lit(False)).cast("int")
        marked = rows.join(ends, ["symbol", "_slice"]).select("symbol", "date", late.alias("_late"))
    per_date = marked.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("_late").alias("late"))
    return (
        per_date.groupBy("symbol")
        .agg(F.sum(F.col("n") - 1).alias("duplicate_dates"), F.sum("late").alias("out_of_order"))
        .withColumn("alignment_ok", (F.col("duplicate_dates") == 0) & (F.col("out_of_order") == 0))
    )


def feature_validation(df: DataFrame, features: Sequence[str], *, expected_nan_rows: int = 0) -> DataFrame:
    """All feature checks per symbol; jumps only warn."""
    nans = nan_inf_summary(df, features, expected_nan_rows=expected_nan_rows).groupBy("symbol").agg(
        F.bool_and("nan_ok").alias("nan_values"), F.bool_and(F.col("inf_count") == 0).alias("infinite_values")
    )
    ranges = range_check(df, features).groupBy("symbol").agg(F.bool_and("range_ok").alias("value_ranges"))
    jumps = jump_check(df, features).groupBy("symbol").agg(F.bool_and(~F.col("jump_warning")).alias("causality"))
    order = temporal_alignment(df).select("symbol", F.col("alignment_ok").alias("temporal_alignment"))
    joined = nans.join(ranges, "symbol").join(jumps, "symbol", "left").join(order, "symbol")
    return joined.withColumn("causality", F.coalesce("causality", F.lit(True))).withColumn(
        "is_valid",
        F.col("nan_values") & F.col("infinite_values") & F.col("value_ranges") & F.col("temporal_alignment"),
    )


def validation_totals(validation: DataFrame) -> DataFrame:
    return validation.agg(
        F.count(F.lit(1)).alias("total_symbols"),
        F.count_if(F.col("is_valid")).alias("symbols_passed"),
        F.count_if(~F.col("is_valid")).alias("symbols_failed"),
    )


# Limits each feature module checks on its own output.
MODULE_RULES: Mapping[str, tuple[float | None, float | None]] = {
    "normalized_close": (-10.0, 10.0),
    "normalized_volume": (0.0, None),
    "rsi_14": (-0.01, 100.01),
    "stoch_k": (-0.01, 100.01),
    "stoch_d": (-0.01, 100.01),
    "adx_value": (-0.01, 100.01),
    "atr_14": (-1e-6, None),
    "volatility_20": (-1e-6, None),
    "relative_strength": (-1.01, 1.01),
    "sector_correlation": (-1.01, 1.01),
    "market_regime": (0.0, 3.0),
}


def module_validators(df: DataFrame, *, rules: Mapping[str, tuple[float | None, float | None]] = MODULE_RULES) -> DataFrame:
    """Per symbol and feature: values outside the limits of its module."""
    present = [c for c in rules if c in df.columns]

    def outside(c: str) -> Column:
        lo, hi = rules[c]
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (F.col(c) < lo)
        if hi is not None:
            bad = bad | (F.col(c) > hi)
        return F.count_if(bad).alias(f"{c}_out")

    wide = df.groupBy("symbol").agg(*[outside(c) for c in present])
    cells = _cells(present, lambda c: [F.col(f"{c}_out").alias("out_of_range")])
    return wide.select("symbol", F.inline(cells)).withColumn("passed", F.col("out_of_range") == 0)


def error_rollup(events: DataFrame) -> DataFrame:
    """Error log (symbol, stage, error_type, severity, action) per type and severity."""
    return events.groupBy("error_type", "severity", "action").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("symbol").alias("affected_symbols")
    )


def quality_events(quality: DataFrame) -> DataFrame:
    """Failed checks of the quality report as error events."""
    event = lambda cond, kind, sev, action: F.when(
        cond,
        F.struct(
            F.lit("validation").alias("stage"),
            F.lit(kind).alias("error_type"),
            F.lit(sev).alias("severity"),
            F.lit(action).alias("action"),
        ),
    )
    rows = F.array_compact(
        F.array(
            event(~F.col("enough_days"), "InsufficientDataError", "error", "skip_symbol"),
            event(~F.col("ordering_ok"), "DataQualityError", "warning", "continue"),
            event(~F.col("stats_ok"), "DataQualityError", "error", "skip_symbol"),
            event(~F.col("stasis_ok"), "DataQualityError", "warning", "continue"),
        )
    )
    return quality.select("symbol", F.inline(rows))
