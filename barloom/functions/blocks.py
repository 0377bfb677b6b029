"""Exact layouts for series too long for one task.

A symbol of an intraday or tick table may hold a third of all rows, and an instant may hold very many of them. Nothing
here puts a whole symbol, or a whole instant, into one task. Rows are sorted over all tasks by range partitions of
(symbol, time, tie-breaker), and a slice is a fixed number of rows that follow each other in one partition. Running
values come from a tree: inside a slice, over slices of a group of slices, over groups of groups. Trailing-window
operators run on fixed-size row blocks that repeat the last ``halo`` rows of the block before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.sinks import materialize

ROWS_PER_BLOCK = 1 << 16
#: Slice totals in one window, and children of a node of the tree above that.
TOTALS = 1 << 14
CHILDREN = 10


def tie_breaker(df: DataFrame) -> Column:
    """A hash of the whole row: rows of one instant get one order, the same in every run."""
    return F.xxhash64(*[f.name for f in df.schema.fields if f.dataType.typeName() != "map"])


def in_slices(
    df: DataFrame, *, symbol_col: str, order_col: str, first: Sequence[str] = (), rows_per_slice: int = ROWS_PER_BLOCK
) -> DataFrame:
    """``df`` with ``_at``, which rises with (symbol, time, ``first``, tie-breaker), and ``_slice``, runs of rows along it.

    A slice holds rows of one partition of the order, at most ``rows_per_slice`` of them (rounded down to a power of two),
    and may hold rows of several symbols. The layout is written once: sampled partition bounds may differ between runs.
    """
    order = [symbol_col, order_col, *first, "_tie"]
    laid = df.withColumn("_tie", tie_breaker(df)).repartitionByRange(*order).sortWithinPartitions(*order)
    # The low 33 bits of this id number the rows of a partition.
    laid = materialize(laid.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), "slices")
    return laid.withColumn("_slice", F.shiftright("_at", min(rows_per_slice.bit_length() - 1, 32)))


def carried(totals: DataFrame, value: str, out: str, *, symbol_col: str, last: bool = False, most: int = TOTALS) -> DataFrame:
    """(symbol, slice, ``out``): the sum of ``value`` over the earlier slices of the symbol, or its last known one.

    ``totals`` has one row per (symbol, slice) and is written. Up to ``most`` rows of a symbol are one window; where there
    are more they are gathered under nodes of 2^CHILDREN slices, whose own totals are carried in the same way.
    """
    combine = F.last(value, True) if last else F.sum(value)
    either = (lambda near, far: F.coalesce(near, far)) if last else (lambda near, far: F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)))
    if (totals.groupBy(symbol_col).count().agg(F.max("count")).first()[0] or 0) <= most:
        before = Window.partitionBy(symbol_col).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(symbol_col, "_slice", either(combine.over(before), F.lit(None)).alias(out))
    under = totals.withColumn("_node", F.shiftright("_slice", CHILDREN))
    before = Window.partitionBy(symbol_col, "_node").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_slice"))) if last else F.sum(value)
    nodes = under.groupBy(symbol_col, "_node").agg(whole.alias(value)).withColumnRenamed("_node", "_slice")
    above = carried(materialize(nodes, "slice-nodes"), value, "_far", symbol_col=symbol_col, last=last, most=most)
    near = under.select(symbol_col, "_slice", "_node", combine.over(before).alias("_near"))
    return near.join(above.withColumnRenamed("_slice", "_node"), [symbol_col, "_node"]).select(
        symbol_col, "_slice", either(F.col("_near"), F.col("_far")).alias(out)
    )


def running_total(
    df: DataFrame,
    value: Column,
    out: str,
    *,
    symbol_col: str = "symbol",
    order_col: str = "date",
    rows_per_slice: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Cumulative sum of ``value`` per symbol without a per-symbol task."""
    sliced = in_slices(df.withColumn("_v", value), symbol_col=symbol_col, order_col=order_col, rows_per_slice=rows_per_slice)
    totals = materialize(sliced.groupBy(symbol_col, "_slice").agg(F.sum("_v").alias("_total")), "slice-totals")
    prior = carried(totals, "_total", "_prior", symbol_col=symbol_col)
    w = Window.partitionBy(symbol_col, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(prior, [symbol_col, "_slice"])
        .withColumn(out, F.col("_prior") + F.coalesce(F.sum("_v").over(w), F.lit(0)))
        .drop("_at", "_slice", "_prior", "_v")
    )


def with_position(
    df: DataFrame,
    out: str = "_pos",
    *,
    symbol_col: str = "symbol",
    order_col: str = "date",
    rows_per_slice: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Zero-based row number per symbol: the number in its slice, after the rows of the slices before."""
    sliced = in_slices(df, symbol_col=symbol_col, order_col=order_col, rows_per_slice=rows_per_slice)
    totals = sliced.groupBy(symbol_col, "_slice").agg(F.count(F.lit(1)).alias("_total"), F.min("_at").alias("_first"))
    prior = carried(materialize(totals.drop("_first"), "slice-totals"), "_total", "_prior", symbol_col=symbol_col)
    # Rows of a symbol follow each other in a slice, so their numbers need no window.
    start = totals.select(symbol_col, "_slice", "_first").join(prior, [symbol_col, "_slice"])
    return (
        sliced.join(start, [symbol_col, "_slice"])
        .withColumn(out, F.col("_prior") + F.col("_at") - F.col("_first"))
        .drop("_at", "_slice", "_prior", "_first")
    )


def in_blocks(
    df: DataFrame,
    op: Callable[[DataFrame], DataFrame],
    *,
    halo: int,
    rows_per_block: int = ROWS_PER_BLOCK,
    symbol_col: str = "symbol",
    order_col: str = "date",
) -> DataFrame:
    """Run a trailing-window ``op`` on row blocks; the result equals the per-symbol run.

    ``halo`` is the op's lookback in rows. ``op`` must keep the columns it is given
    and group by ``symbol_col`` only; each block looks to it like a symbol.
    """
    placed = with_position(
        df, symbol_col=symbol_col, order_col=order_col, rows_per_slice=rows_per_block
    )
    home = F.floor(F.col("_pos") / rows_per_block)
    last = F.floor((F.col("_pos") + halo) / rows_per_block)
    copies = placed.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(home, last)))
    keyed = copies.withColumns(
        {
            "_symbol": F.col(symbol_col),
            symbol_col: F.concat_ws("\u0001", F.col(symbol_col), F.col("_block").cast("string")),
        }
    )
    return (
        op(keyed)
        .where(F.col("_block") == F.col("_home"))
        .withColumn(symbol_col, F.col("_symbol"))
        .drop("_symbol", "_block", "_home", "_pos")
    )
