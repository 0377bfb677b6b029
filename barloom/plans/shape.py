"""Common output shape of a registered query: dates as text, floats rounded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("symbol", "date")


def _is_date(name: str) -> bool:
    return name.endswith("date") or name in ("min_day", "max_day")


def shaped(df: DataFrame, keys: Sequence[str], digits: Mapping[str, int]) -> DataFrame:
    """Keep ``keys`` as they are and round the others; adding 0.0 removes the sign of zero."""
    plain: list[Column] = [F.col(k).cast("string").alias(k) if _is_date(k) else F.col(k) for k in keys]
    return df.select(*plain, *[(F.round(F.col(c).cast("double"), d) + 0.0).alias(c) for c, d in digits.items()])


def shaped_sql(query: str, keys: Sequence[str], digits: Mapping[str, int]) -> str:
    plain = [f"CAST({k} AS VARCHAR) AS {k}" if _is_date(k) else f'"{k}"' for k in keys]
    rounded = [f"round(CAST({c} AS DOUBLE), {d}) + 0e0 AS {c}" for c, d in digits.items()]
    return f"SELECT {', '.join(plain + rounded)} FROM ({query}) AS answer"
