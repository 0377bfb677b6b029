"""Second-moment matrices in one distributed pass, and the small solves on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Moments:
    """Sums of [1, x, y] [1, x, y]' over the rows of one group, x and y shifted and scaled by ``center``/``spread``."""

    matrix: np.ndarray

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.matrix + other.matrix)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.matrix - other.matrix)


@dataclass(frozen=True)
class MomentTable:
    features: tuple[str, ...]
    center: np.ndarray
    spread: np.ndarray
    groups: dict[str, Moments]


def moments(df: DataFrame, features: Sequence[str], target: str, group: str) -> MomentTable:
    """One matrix per value of ``group``, from one pass after a pass for means and deviations.

    Every task folds its rows into the upper triangle of one matrix per group, and the triangles are added in the
    cluster: the shuffle carries tasks x groups x (p + 2)^2 / 2 numbers whatever the row count, and the driver gets
    one array per group.
    """
    columns = [*features, target]
    stats = df.agg(*[a for c in columns for a in (F.avg(c), F.stddev_pop(c))]).first()
    center = np.array([v if v is not None else 0.0 for v in stats[0::2]], dtype=float)
    spread = np.array([v if v else 1.0 for v in stats[1::2]], dtype=float)
    size = len(columns) + 1
    upper = np.triu_indices(size)

    def fold(batches):
        totals: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, part in pdf.groupby("_g", sort=False):
                z = (part[columns].to_numpy(dtype=float) - center) / spread
                m = np.column_stack([np.ones(len(z)), z])
                totals[name] = totals.get(name, 0.0) + m.T @ m
        if totals:
            yield pd.DataFrame({"_g": list(totals), "m": [t[upper] for t in totals.values()]})

    partial = df.select(F.col(group).cast("string").alias("_g"), *columns).na.drop().mapInPandas(
        fold, "_g STRING, m ARRAY<DOUBLE>"
    )
    summed = partial.select("_g", F.posexplode("m").alias("i", "v")).groupBy("_g", "i").agg(F.sum("v").alias("v"))
    packed = summed.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m"))
    found: dict[str, Moments] = {}
    for row in packed.select("_g", F.col("m.v").alias("m")).collect():  # one row per group
        matrix = np.zeros((size, size))
        matrix[upper] = row["m"]
        found[row["_g"]] = Moments(matrix + np.triu(matrix, 1).T)
    return MomentTable(tuple(features), center, spread, found)


def least_squares(
    table: MomentTable, m: Moments, *, keep: Sequence[int] | None = None, alpha: float = 0.0, scale: np.ndarray | None = None
) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) in the original units from the moments of the fit rows.

    ``keep`` restricts the features (a sub-matrix, no new pass). With ``alpha`` the penalty
    applies to coefficients of features divided by ``scale`` (in units of ``spread``).
    """
    p = len(table.features)
    keep = list(range(p)) if keep is None else list(keep)
    a = m.matrix
    idx = [i + 1 for i in keep]
    mean_x, mean_y = a[0, idx] / m.n, a[0, p + 1] / m.n
    xx = a[np.ix_(idx, idx)] - m.n * np.outer(mean_x, mean_x)
    xy = a[idx, p + 1] - m.n * mean_x * mean_y
    if alpha:
        s = scale[keep] if scale is not None else np.ones(len(keep))
        w = np.linalg.solve(xx / np.outer(s, s) + alpha * np.eye(len(keep)), xy / s) / s
    else:
        w = np.linalg.lstsq(xx, xy, rcond=1e-12)[0]
    b = mean_y - mean_x @ w
    coef = np.zeros(p)
    coef[keep] = w * table.spread[p] / table.spread[keep]
    intercept = b * table.spread[p] + table.center[p] - float(coef @ table.center[:p])
    return float(intercept), coef


def squared_error(table: MomentTable, m: Moments, intercept: float, coef: np.ndarray) -> float:
    """Sum of squared errors of a fit over the rows behind ``m``."""
    p = len(table.features)
    v = np.empty(p + 2)
    v[1 : p + 1] = coef * table.spread[:p]
    v[p + 1] = -table.spread[p]
    v[0] = intercept + float(coef @ table.center[:p]) - table.center[p]
    return float(v @ m.matrix @ v)


def total_variation(m: Moments, table: MomentTable) -> float:
    """Sum of squared deviations of the target from its mean."""
    p = len(table.features)
    return float((m.matrix[p + 1, p + 1] - m.matrix[0, p + 1] ** 2 / m.n) * table.spread[p] ** 2)
