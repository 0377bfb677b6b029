"""How a query is registered: a Spark plan and, where SQL can say it, the same answer in SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barloom.plans.shape import KEYS, shaped, shaped_sql

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    plan: Plan
    sql: str | None = None


def entry(
    plan: Plan,
    query: str | None = None,
    *,
    keys: Sequence[str] = KEYS,
    digits: Mapping[str, int] | None = None,
) -> Entry:
    digits = digits or {}
    return Entry(
        lambda spark, sf_dir: shaped(plan(spark, sf_dir), keys, digits),
        None if query is None else shaped_sql(query, keys, digits),
    )


def same(names: Sequence[str] | str, digits: int = 6) -> dict[str, int]:
    """The same rounding for several columns."""
    listed = names.split() if isinstance(names, str) else names
    return {n: digits for n in listed}
