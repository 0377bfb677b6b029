"""Leakage checks. Each returns violation rows (violation_type, severity, affected, count)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _event(cond: Column, kind: str, severity: str, affected: Column, count: Column) -> Column:
    return F.when(
        cond,
        F.struct(
            F.lit(kind).alias("violation_type"),
            F.lit(severity).alias("severity"),
            affected.cast("string").alias("affected"),
            count.cast("bigint").alias("violations"),
        ),
    )


def _rows(df: DataFrame, *events: Column) -> DataFrame:
    return df.select(F.inline(F.array_compact(F.array(*events))))


def leak_artifact(
    df: DataFrame, *, fit_data_source: str | None = None, fit_date: str | None = None
) -> DataFrame:
    """Splits must follow each other; artifacts must come from the training rows."""

    def edge(fn, name: str) -> Column:
        return fn(F.when(F.col("split") == name, F.col("date")))

    ranges = df.agg(
        edge(F.min, "train").alias("t0"),
        edge(F.max, "train").alias("t1"),
        edge(F.min, "validation").alias("v0"),
        edge(F.max, "validation").alias("v1"),
        edge(F.min, "test").alias("s0"),
    )
    one = F.lit(1)
    source = F.lit(fit_data_source)
    fitted = F.lit(fit_date).cast("date")
    return _rows(
        ranges,
        _event(F.col("t1") >= F.col("v0"), "temporal_overlap", "CRITICAL", F.lit("train/validation"), one),
        _event(F.col("v1") >= F.col("s0"), "temporal_overlap", "CRITICAL", F.lit("validation/test"), one),
        _event(source.isNotNull() & ~source.isin("training", "train"), "artifact_fit_leakage", "CRITICAL", source, one),
        _event(
            fitted.isNotNull() & ~fitted.between(F.col("t0"), F.col("t1")), "artifact_date_mismatch", "ERROR", fitted, one
        ),
    )


def leak_lookahead(
    df: DataFrame, features: Sequence[str], *, lookback_windows: Mapping[str, int] | None = None
) -> DataFrame:
    """Warn when nulls exceed a tenth of the row count; windows must be positive."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in features])
    total = df.agg(F.count(F.lit(1)).alias("n"), nulls.alias("nulls"))
    events = [
        _event(F.col("nulls") > F.col("n") * 0.1, "excessive_nan", "WARNING", F.lit("features"), F.col("nulls"))
    ]
    for name, size in (lookback_windows or {}).items():
        events.append(_event(F.lit(size <= 0), "invalid_lookback", "ERROR", F.lit(name), F.lit(1)))
    return _rows(total, *events)


def leak_split(rows: DataFrame, total_rows: int | Column) -> DataFrame:
    """Overlaps, duplicates, ids out of [0, total_rows) and uncovered ids among (split, row_id) rows.

    Ids are compared by one aggregation; the missing ones are counted, never listed.
    """
    has = lambda name: F.max((F.col("split") == name).cast("int"))
    per_id = rows.groupBy("row_id").agg(
        has("train").alias("t"), has("validation").alias("v"), has("test").alias("s"), F.count(F.lit(1)).alias("n")
    )
    total = F.lit(total_rows) if isinstance(total_rows, int) else total_rows
    inside = (F.col("row_id") >= 0) & (F.col("row_id") < total)
    counts = per_id.agg(
        F.count_if(F.col("t") + F.col("v") == 2).alias("tv"),
        F.count_if(F.col("t") + F.col("s") == 2).alias("ts"),
        F.count_if(F.col("v") + F.col("s") == 2).alias("vs"),
        (F.sum("n") - F.count(F.lit(1))).alias("dup"),
        F.count_if(~inside).alias("out"),
        F.count_if(inside).alias("seen"),
    ).withColumn("open", total - F.col("seen"))
    found = lambda c, kind, sev, what: _event(F.col(c) > 0, kind, sev, F.lit(what), F.col(c))
    return _rows(
        counts,
        found("tv", "train_val_overlap", "CRITICAL", "train/validation"),
        found("ts", "train_test_overlap", "CRITICAL", "train/test"),
        found("vs", "val_test_overlap", "CRITICAL", "validation/test"),
        found("dup", "duplicate_indices", "ERROR", "all"),
        found("out", "invalid_indices", "ERROR", "all"),
        found("open", "incomplete_coverage", "WARNING", "all"),
    )


def leak_cv(folds: DataFrame) -> DataFrame:
    """Per fold: ids on both sides (fold, side, row_id)."""
    shared = (
        folds.groupBy("fold", "row_id")
        .agg(F.count_distinct("side").alias("n"))
        .where("n > 1")
        .groupBy("fold")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return shared.select(
        F.lit("cv_fold_overlap").alias("violation_type"),
        F.lit("CRITICAL").alias("severity"),
        F.concat(F.lit("fold "), F.col("fold").cast("string")).alias("affected"),
        F.col("n").cast("bigint").alias("violations"),
    )


def leak_report(violations: DataFrame) -> DataFrame:
    """Totals by severity; leakage is detected when anything is CRITICAL."""
    level = lambda s: F.count_if(F.col("severity") == s)
    return violations.agg(
        F.count(F.lit(1)).alias("total_violations"),
        level("CRITICAL").alias("critical"),
        level("ERROR").alias("errors"),
        level("WARNING").alias("warnings"),
        (level("CRITICAL") > 0).alias("leakage_detected"),
    )


def union_dates(*frames: DataFrame) -> DataFrame:
    """Distinct dates of all frames."""
    return reduce(DataFrame.unionByName, [f.select("date") for f in frames]).distinct()


def shared_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row ids in both."""
    return a.select("row_id").intersect(b.select("row_id"))


def uncovered_rows(everything: DataFrame, used: DataFrame) -> DataFrame:
    """Row ids that no split uses."""
    return everything.select("row_id").exceptAll(used.select("row_id").distinct())
