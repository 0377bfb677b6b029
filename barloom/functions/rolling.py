"""Window helpers.

Missing values are NULL only. A rolling value is NULL unless every one of its
``n`` rows is present, so a gap inside the frame yields NULL.

Window groups are the rows of one ``symbol``. For daily bars the group is
bounded: ``normalize_bars`` keeps one row per (symbol, date), so a symbol holds
at most one row per calendar day (36,525 a century, a few MB) however large
the input is. Series without that bound (intraday, ticks) run the same
operators through :func:`barloom.functions.blocks.in_blocks`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Stage = dict[str, Column]


def series_window(symbol_col: str = "symbol", date_col: str = "date") -> WindowSpec:
    return Window.partitionBy(symbol_col).orderBy(date_col)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def roll(agg: Callable[[Column], Column], col: Column | str, n: int, w: WindowSpec) -> Column:
    """Trailing aggregate over ``n`` rows, NULL until all ``n`` values are present."""
    c = F.col(col) if isinstance(col, str) else col
    frame = trailing(w, n)
    return F.when(F.count(c).over(frame) == n, agg(c).over(frame))


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL on a zero denominator."""
    return F.try_divide(num, den)


def rolling_corr(x: Column, y: Column, n: int, w: WindowSpec) -> Column:
    """Trailing Pearson correlation, NULL until ``n`` complete pairs or on a flat frame."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    frame = trailing(w, n)
    spread = F.stddev_samp(px).over(frame) * F.stddev_samp(py).over(frame)
    return F.when(
        F.count(px).over(frame) == n,
        F.try_divide(F.covar_samp(px, py).over(frame), spread),
    )


def add_stages(df: DataFrame, stages: Iterable[Stage]) -> DataFrame:
    """Apply column stages in order; each stage may read the columns of earlier ones."""
    for stage in stages:
        if stage:
            df = df.withColumns(stage)
    return df


def merge_stages(groups: Iterable[list[Stage]]) -> list[Stage]:
    """Merge stage lists level by level, so equal windows share one Window node."""
    merged: list[Stage] = []
    for stages in groups:
        for level, stage in enumerate(stages):
            while len(merged) <= level:
                merged.append({})
            merged[level].update(stage)
    return merged


def drop_private(df: DataFrame) -> DataFrame:
    """Drop helper columns (leading underscore)."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def clean_floats(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Turn NaN into NULL, the only missing value inside the engine."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
