"""Linear recurrences (exponential means, local-level filter) as window sums.

``y[t] = a[t] * y[t-1] + b[t]`` unrolls to a weighted sum. With the decay clock
``g[t] = sum(-ln a)``, ``y[t] = exp(-g[t]) * sum(b[i] * exp(g[i]))``. The clock is cut
into blocks of ``BLOCK`` units so the exponentials stay in range, and one value is
carried over each cut; what lies two blocks back weighs less than exp(-BLOCK).
Everything is O(1) a row inside the JVM: no Python, no arrays.

The clock is kept as (number of inputs) * unit + extra, so that differences of it
stay exact to the last bit on long series.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import before, series_window, upto

BLOCK = 300.0
SPREAD = 5.0  # fastest to slowest mean of one call; the slowest still forgets exp(-50) in a block


@dataclass(frozen=True)
class Term:
    """One recurrence: b[t] in column ``push`` (NULL where there is no input) and
    -ln a[t] = ``unit`` + column ``extra`` (NULL counts as 0). Terms with input on the same
    rows name the same ``input`` column and share one counter."""

    out: str
    unit: float
    push: str
    extra: str | None = None
    input: str | None = None

    @property
    def counted(self) -> str:
        return self.input or self.push


def linear_recurrence(
    df: DataFrame, terms: list[Term], *, symbol_col: str = "symbol", date_col: str = "date"
) -> DataFrame:
    """Solve every term; rows without input repeat the last value.

    Terms solved in one call share the block cuts, so they share the sorts.
    """
    w = series_window(symbol_col, date_col)
    wb = Window.partitionBy(symbol_col, "_lr_blk").orderBy(date_col)
    index = range(len(terms))

    counters = {c: f"_lr_n_{c}" for c in dict.fromkeys(t.counted for t in terms)}
    extras = {i: f"_lr_x{i}" for i in index if terms[i].extra is not None}

    def clock(i: int, tag: str = "") -> Column:
        """Clock of term ``i`` now, or as kept in the columns with the given tag."""
        g = F.col(counters[terms[i].counted] + tag) * terms[i].unit
        return g + F.col(extras[i] + tag) if i in extras else g

    def since(i: int, tag: str) -> Column:
        n = counters[terms[i].counted]
        age = (F.col(n) - F.col(n + tag)) * terms[i].unit
        return age + (F.col(extras[i]) - F.col(extras[i] + tag)) if i in extras else age

    def kept(tag: str, how) -> dict[str, Column]:
        """Counters and extra sums as ``how(column, input)`` sees them, under a tag."""
        cols = {n + tag: how(n, c) for c, n in counters.items()}
        return cols | {x + tag: how(x, terms[i].counted) for i, x in extras.items()}

    clocks = {n: F.count(c).over(upto(w)) for c, n in counters.items()}
    clocks |= {x: F.coalesce(F.sum(terms[i].extra).over(upto(w)), F.lit(0.0)) for i, x in extras.items()}
    df = df.withColumns(clocks)
    time = [clock(i) for i in index]
    df = df.withColumn("_lr_blk", F.floor((F.greatest(*time) if len(time) > 1 else time[0]) / BLOCK))
    # First input of the block: the exponentials are taken relative to it.
    first = lambda col, inp: F.first(F.when(F.col(inp).isNotNull(), F.col(col)), True).over(upto(wb))
    df = df.withColumns(kept("_b", first))
    df = df.withColumns(
        {f"_lr_sum{i}": F.sum(F.col(terms[i].push) * F.exp(since(i, "_b"))).over(upto(wb)) for i in index}
    )
    df = df.withColumns({f"_lr_loc{i}": F.col(f"_lr_sum{i}") * F.exp(-since(i, "_b")) for i in index})
    # Last input before the row, and of that what was known where the block was cut.
    base = {c: n + "_b" for c, n in counters.items()}
    last = lambda col, inp: F.last(F.when(F.col(base[inp]).isNotNull(), F.col(col)), True).over(before(w))
    prior = kept("_p", last) | {"_lr_cut": F.lag("_lr_blk").over(w) != F.col("_lr_blk")}
    prior |= {f"_lr_pv{i}": F.last(f"_lr_loc{i}", True).over(before(w)) for i in index}
    df = df.withColumns(prior)
    at_cut = lambda col, inp=None: F.last(F.when(F.col("_lr_cut"), F.col(col)), True).over(upto(w))
    carried = kept("_c", lambda col, inp: at_cut(col + "_p")) | {f"_lr_cv{i}": at_cut(f"_lr_pv{i}") for i in index}
    df = df.withColumns(carried)
    out: dict[str, Column] = {}
    for i, t in enumerate(terms):
        inherited = F.col(f"_lr_cv{i}") * F.exp(-since(i, "_c"))
        out[t.out] = F.when(
            F.col(f"_lr_loc{i}").isNotNull() | inherited.isNotNull(),
            F.coalesce(F.col(f"_lr_loc{i}"), F.lit(0.0)) + F.coalesce(inherited, F.lit(0.0)),
        )
    df = df.withColumns(out)
    return df.drop(*[c for c in df.columns if c.startswith("_lr_")])


@dataclass(frozen=True)
class Ewm:
    """Exponential mean of ``column`` with the given span (alpha = 2 / (span + 1))."""

    out: str
    column: str
    span: float

    @property
    def alpha(self) -> float:
        return 2.0 / (self.span + 1.0)


def _ewm_dense(df: DataFrame, specs: list[Ewm], symbol_col: str, date_col: str) -> DataFrame:
    """``ewm`` for columns without NULLs after their first value.

    Every step then decays alike, so blocks are plain row ranges: one window sums inside
    the block, one range frame takes the total of the block before.
    """
    w = series_window(symbol_col, date_col)
    columns = list(dict.fromkeys(s.column for s in specs))
    units = [-math.log1p(-s.alpha) for s in specs]
    rows = max(int(BLOCK / max(units)), 1)
    n = {c: f"_lr_n_{c}" for c in columns}
    df = df.withColumns({n[c]: F.count(c).over(upto(w)) for c in columns} | {"_lr_at": F.row_number().over(w) - 1})
    df = df.withColumns({"_lr_blk": F.floor(F.col("_lr_at") / rows), "_lr_age": F.col("_lr_at") % rows})
    gap = F.raise_error(F.lit("a series has gaps: clean it first, or compute with gaps=True"))
    pushes = {}
    for i, s in enumerate(specs):
        x, seen = F.col(s.column), F.col(n[s.column])
        held = F.when(x.isNull() & (seen > 0), gap.cast("double")).otherwise(x)
        share = F.when(seen == 1, 1.0).otherwise(s.alpha)
        pushes[f"_lr_p{i}"] = held * share * F.exp(F.col("_lr_age") * units[i])
    df = df.withColumns(pushes)
    inside = Window.partitionBy(symbol_col, "_lr_blk").orderBy(date_col)
    earlier = Window.partitionBy(symbol_col).orderBy("_lr_blk").rangeBetween(-1, -1)
    df = df.withColumns({f"_lr_s{i}": F.sum(f"_lr_p{i}").over(upto(inside)) for i in range(len(specs))})
    # The sum on the last row of a block is its total. Built on the sums before it, this window
    # keeps their sort order.
    df = df.withColumns({f"_lr_e{i}": F.max_by(f"_lr_s{i}", date_col).over(earlier) for i in range(len(specs))})
    out = {}
    for i, s in enumerate(specs):
        here, past = F.col(f"_lr_s{i}"), F.coalesce(F.col(f"_lr_e{i}"), F.lit(0.0)) * math.exp(-units[i] * rows)
        total = (F.coalesce(here, F.lit(0.0)) + past) * F.exp(-F.col("_lr_age") * units[i])
        out[s.out] = F.when(F.col(n[s.column]) > 0, total)
    df = df.withColumns(out)
    return df.drop(*[c for c in df.columns if c.startswith("_lr_")])


def ewm_halo(specs: list[Ewm], tolerance: float = 1e-18) -> int:
    """Rows after which the start of a block weighs less than ``tolerance`` in every mean."""
    return max(math.ceil(math.log(tolerance) / math.log1p(-s.alpha)) if s.alpha < 1 else 1 for s in specs)


def ewm(
    df: DataFrame,
    specs: list[Ewm],
    *,
    gaps: bool = True,
    symbol_col: str = "symbol",
    date_col: str = "date",
) -> DataFrame:
    """Recursive exponential mean, started at the first value.

    Leading NULLs are skipped. Across a gap of ``k`` rows the old value weighs
    (1 - alpha)**k and the weights are renormalised; the gap rows repeat the mean.
    ``gaps=False`` is cheaper, and fails on a NULL after the first value.
    """
    # Means solved together share the block cuts, which suit decays of like speed only.
    pools: list[list[Ewm]] = []
    for s in sorted(specs, key=lambda s: s.span):
        if pools and s.span + 1 <= SPREAD * (pools[-1][0].span + 1):
            pools[-1].append(s)
        else:
            pools.append([s])
    if len(pools) > 1:
        for pool in pools:
            df = ewm(df, pool, gaps=gaps, symbol_col=symbol_col, date_col=date_col)
        return df
    if not gaps:
        return _ewm_dense(df, specs, symbol_col, date_col)
    w = series_window(symbol_col, date_col)
    df = df.withColumn("_at", F.row_number().over(w))
    columns = list(dict.fromkeys(s.column for s in specs))
    seen = {
        f"_seen_{c}": F.last(F.when(F.col(c).isNotNull(), F.col("_at")), True).over(before(w)) for c in columns
    }
    df = df.withColumns(seen)
    terms, inputs = [], {}
    for i, s in enumerate(specs):
        prev, x, alpha = F.col(f"_seen_{s.column}"), F.col(s.column), s.alpha
        unit = -math.log1p(-alpha)
        gap = F.col("_at") - prev
        kept = F.pow(F.lit(1.0 - alpha), gap)
        inputs[f"_extra_{i}"] = F.when(x.isNotNull() & (gap > 1), F.log(kept + alpha) + (gap - 1) * unit)
        inputs[f"_push_{i}"] = (
            F.when(prev.isNull(), x).when(gap == 1, x * alpha).otherwise(x * alpha / (kept + alpha))
        )
        terms.append(Term(s.out, unit, f"_push_{i}", f"_extra_{i}", s.column))
    df = linear_recurrence(df.withColumns(inputs), terms, symbol_col=symbol_col, date_col=date_col)
    return df.drop("_at", *seen, *inputs)
