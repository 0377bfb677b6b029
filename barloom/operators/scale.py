"""Standard scaling fitted on training rows only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.guards import broadcast_if_small

VERSION = re.compile(r"v[1-9]\d*")


def _scope_key(scope: str) -> Column:
    if scope not in ("global", "symbol"):
        raise ValueError("scope must be 'global' or 'symbol'")
    return F.col("symbol") if scope == "symbol" else F.lit("*")


def _finite(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.coalesce(F.abs(x) < float("inf"), F.lit(False))


def fingerprint(features: Sequence[str]) -> Column:
    """Order-free fingerprint of the rows."""
    return F.bit_xor(F.xxhash64("symbol", "date", *[F.col(c).cast("double") for c in features]))


def _fit_by(df: DataFrame, features: Sequence[str], key: Column) -> DataFrame:
    aggs: list[Column] = []
    clean = F.lit(True)
    for c in features:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"mean_{c}"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"scale_{c}")]
        clean = clean & _finite(c)
    return df.groupBy(key).agg(
        *aggs,
        F.count(F.lit(1)).alias("fit_rows"),
        F.count_if(~clean).alias("bad_rows"),
        F.min("date").alias("fit_start_date"),
        F.max("date").alias("fit_end_date"),
        fingerprint(features).alias("fingerprint"),
    )


def scaler_fit(df: DataFrame, features: Sequence[str], *, split_name: str = "train", scope: str = "global") -> DataFrame:
    """Mean and population deviation per feature over the training rows, in one wide row per scope.

    A constant feature gets scale 1. Any other split, and missing or infinite values, are refused.
    """
    if split_name != "train":
        raise ValueError("a scaler is fitted on the training split only")
    fitted = _fit_by(df.where(F.col("split") == "train"), features, _scope_key(scope).alias("scope"))
    refused = F.raise_error(F.lit("training features hold missing or infinite values"))
    checked = F.when(F.col("bad_rows") > 0, refused.cast("bigint")).otherwise(F.col("fit_rows"))
    return fitted.withColumn("fit_rows", checked).withColumn("fit_split", F.lit("train")).drop("bad_rows")


def scaler_stats(params: DataFrame, features: Sequence[str]) -> DataFrame:
    """The same parameters, one row per scope and feature."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"), F.col(f"scale_{c}").alias("scale"))
            for c in features
        ]
    )
    return params.select("scope", "fit_rows", "fit_start_date", "fit_end_date", F.inline(cells))


def scaler_apply(df: DataFrame, params: DataFrame, features: Sequence[str], *, scope: str = "global") -> DataFrame:
    """(x - mean) / scale on every split; the feature set must be the fitted one."""
    fitted = [c[len("mean_") :] for c in params.columns if c.startswith("mean_")]
    if list(features) != fitted:
        raise ValueError(f"features {list(features)} differ from the fitted ones {fitted}")
    stats = params.select(
        F.col("scope").alias("_scope"), *[F.col(f"{k}_{c}").alias(f"_{k}_{c}") for c in features for k in ("mean", "scale")]
    )
    if scope == "global":
        row = params.where("scope = '*'").first()  # one row
        if row is None:
            return df.limit(0)
        return df.withColumns({c: (F.col(c) - F.lit(row[f"mean_{c}"])) / F.lit(row[f"scale_{c}"]) for c in features})
    joined = df.withColumn("_scope", _scope_key(scope)).join(stats, "_scope")
    scaled = {c: (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_scale_{c}") for c in features}
    helpers = [f"_{k}_{c}" for c in features for k in ("mean", "scale")]
    return joined.withColumns(scaled).drop("_scope", *helpers)


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-12 + 1e-9 * F.abs(b)


def scaler_verify(df: DataFrame, params: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per split: whether a refit there equals the parameters.

    On train it must (same rows, same fingerprint, same statistics); on the others it must not.
    """
    refit = _fit_by(df.where(F.col("split").isin("train", "validation", "test")), features, F.col("split").alias("split"))
    given = params.where("scope = '*'").first()  # one row
    if given is None:
        return refit.limit(0).select("split", F.col("fit_rows").alias("row_count"), *[F.lit(True).alias(c) for c in ("same_statistics", "same_rows", "passed")])
    both = refit.withColumns({f"g_{c}": F.lit(given[c]) for c in params.columns})
    same = F.lit(True)
    for c in features:
        same = same & _close(F.col(f"mean_{c}"), F.col(f"g_mean_{c}")) & _close(F.col(f"scale_{c}"), F.col(f"g_scale_{c}"))
    matches = F.col("fingerprint") == F.col("g_fingerprint")
    rows = F.col("fit_rows") == F.col("g_fit_rows")
    train = F.col("split") == "train"
    return both.select(
        "split",
        F.col("fit_rows").alias("row_count"),
        same.alias("same_statistics"),
        matches.alias("same_rows"),
        F.when(train, same & matches & rows & (F.col("g_fit_split") == "train")).otherwise(~same).alias("passed"),
    )


def save_artifact(params: DataFrame, path: str, *, version: str) -> None:
    """Store fitted parameters under a version; only parameters of the training split are accepted."""
    if not VERSION.fullmatch(version):
        raise ValueError("version must look like v1, v2, ...")
    refused = F.raise_error(F.lit("artifact was not fitted on the training split"))
    checked = F.when(F.col("fit_split") != "train", refused).otherwise(F.col("fit_split"))
    params.withColumn("fit_split", checked).withColumn("version", F.lit(version)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("version").parquet(path)


def load_artifact(spark: SparkSession, path: str, *, version: str) -> DataFrame:
    if not VERSION.fullmatch(version):
        raise ValueError("version must look like v1, v2, ...")
    return spark.read.parquet(path).where(F.col("version") == version).drop("version")
