"""Detecting and correcting bad bars, adjusting for corporate actions, and the cleaning report.

Every step keeps the (symbol) distribution of the step before, so a whole cleaning
run needs one exchange of the bars. Side tables join on ``symbol`` alone for the
same reason: their rows travel packed per symbol instead of re-shuffling the bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import before, ratio, roll, series_window, upto
from barloom.sources.bars import OHLCV, PRICES

VIOLATIONS = {
    "high_lt_close": "high < close",
    "close_lt_low": "close < low",
    "low_lt_open": "open < low",
    "high_lt_open": "high < open",
    "high_lt_low": "high < low",
}


# Detection


def missing_reasons() -> list[Column]:
    """One text per OHLCV column: why the value counts as missing, else NULL."""
    reasons = [
        F.when(F.col(c).isNull(), "NaN").when(F.col(c) == 0, "zero").when(F.col(c) < 0, "negative") for c in PRICES
    ]
    return [*reasons, F.when(F.col("volume").isNull(), "NaN").when(F.col("volume") == 0, "zero")]


def detect_missing(df: DataFrame) -> DataFrame:
    """One row per missing, zero or negative value. Negative volume is not flagged."""
    cells = F.array(
        *[
            F.when(r.isNotNull(), F.struct(F.lit(c).alias("column"), r.alias("reason")))
            for c, r in zip(OHLCV, missing_reasons())
        ]
    )
    return df.select("symbol", "date", F.inline(F.array_compact(cells)))


def date_gaps(df: DataFrame) -> DataFrame:
    """Consecutive bars more than one calendar day apart (weekends count)."""
    prev = F.lag("date").over(series_window())
    return (
        df.select("symbol", prev.alias("start_date"), F.col("date").alias("end_date"))
        .withColumn("gap_days", F.datediff("end_date", "start_date"))
        .where("gap_days > 1")
        .withColumn("reason", F.lit("missing"))
    )


def unfillable_gaps(df: DataFrame, *, max_consecutive_gaps: int = 2) -> DataFrame:
    return date_gaps(df).where(F.col("gap_days") > max_consecutive_gaps)


def severity(ret: Column) -> Column:
    size = F.abs(ret)
    return F.when(size > 0.5, "high").when(size > 0.3, "medium").otherwise("low")


def spike_return(threshold: float) -> tuple[Column, Column]:
    """(previous close, return) against the last non-null close; NULL unless the move is a spike."""
    prev = F.last("close", True).over(before(series_window()))
    # From zero to anything else is an infinite move, as large as a spike can be.
    jump = F.signum("close") * F.lit(float("inf"))
    ret = F.when((prev == 0) & (F.col("close") != 0), jump).otherwise(ratio(F.col("close"), prev) - 1.0)
    return prev, F.when(F.abs(ret) > threshold, ret)


def detect_spikes(df: DataFrame, *, threshold: float = 0.20) -> DataFrame:
    """Closes that moved by more than ``threshold`` from the last known close."""
    prev, ret = spike_return(threshold)
    return (
        df.select("symbol", "date", "close", prev.alias("previous_close"), ret.alias("daily_return"))
        .where(F.col("daily_return").isNotNull())
        .select(
            "symbol",
            "date",
            F.lit("close").alias("column"),
            "daily_return",
            "previous_close",
            F.col("close").alias("current_value"),
            severity(F.col("daily_return")).alias("severity"),
        )
    )


def by_severity(events: DataFrame, level: str) -> DataFrame:
    return events.where(F.col("severity") == level)


def violation_list() -> Column:
    """Broken order rules of a bar; empty when any price is missing."""
    # A comparison with NULL is not true, but the rule is to skip the whole bar.
    known = " AND ".join(f"{c} IS NOT NULL" for c in PRICES)
    cells = ", ".join(f"IF({known} AND {bad}, '{name}', NULL)" for name, bad in VIOLATIONS.items())
    return F.expr(f"array_compact(array({cells}))")


def ohlc_violations(df: DataFrame) -> DataFrame:
    """One row per broken order rule."""
    return df.select("symbol", "date", F.explode(violation_list()).alias("violation_type"), *PRICES)


def price_ordering(df: DataFrame) -> DataFrame:
    """Valid and total bars per symbol; bars with a missing price count in the total only."""
    return df.groupBy("symbol").agg(
        F.count_if(is_ordered()).alias("valid_bars"), F.count(F.lit(1)).alias("total_bars")
    )


def is_ordered() -> Column:
    o, h, l, c = (F.col(x) for x in PRICES)
    return (l <= o) & (o <= h) & (l <= c) & (c <= h) & (l <= h)


# Filling


def _in_long_run(column: str, k: int, w) -> Column:
    """Whether a missing row lies in a run of more than ``k`` missing rows.

    True when some ``k + 1`` consecutive rows around it are all missing; only ``k`` rows
    either side are looked at.
    """
    missing = F.col(column).isNull()
    at = {o: F.lag(missing, -o, False).over(w) if o else missing for o in range(-k, k + 1)}
    found = F.lit(False)
    for start in range(-k, 1):
        all_missing = at[start]
        for o in range(start + 1, start + k + 1):
            all_missing = all_missing & at[o]
        found = found | all_missing
    return found


def fill_limited(
    df: DataFrame, *, max_consecutive_days: int = 2, flags: bool = False, run_lengths: bool = False
) -> DataFrame:
    """Carry prices over runs of at most ``max_consecutive_days`` missing values; drop longer runs.

    Columns are handled in order, and the rows one column drops are gone before the runs
    of the next are measured. A short run at the start stays NULL. One window per column.
    With ``flags``, ``_fill_<column>`` holds 1 on filled rows; with ``run_lengths``,
    ``_run_<column>`` the run length on the first row of a run.
    """
    k = max_consecutive_days
    w = series_window()
    for c in PRICES:
        x, names = F.col(c), df.columns
        # A short run has its last known value at most k rows back, in rows no filter removes.
        carried = F.last(x, True).over(w.rowsBetween(-k, -1)) if k > 0 else F.lit(None).cast("double")
        new = {"_carried": carried, "_long": x.isNull() & _in_long_run(c, k, w)}
        if run_lengths:
            new["_at"] = F.row_number().over(w)
            new["_known_before"] = F.coalesce(F.lag(x.isNotNull()).over(w), F.lit(True))
        df = df.withColumns(new)
        if run_lengths:
            ahead = w.rowsBetween(1, max(k, 1))
            end = F.coalesce(F.min(F.when(x.isNotNull(), F.col("_at"))).over(ahead), F.max("_at").over(ahead) + 1)
            first = x.isNull() & F.col("_known_before")
            length = F.coalesce(end, F.col("_at") + 1) - F.col("_at")
            df = df.withColumn(f"_run_{c}", F.when(first, length))
            names = [*names, f"_run_{c}"]
        kept = [F.coalesce(x, F.col("_carried")).alias(c) if n == c else F.col(n) for n in names]
        if flags:
            kept.append(F.expr(f"CAST({c} IS NULL AND _carried IS NOT NULL AS INT)").alias(f"_fill_{c}"))
        df = df.where(~F.col("_long")).select(*kept)
    return df


def fill_runs(df: DataFrame, *, max_consecutive_days: int = 2) -> DataFrame:
    """One record per short run of missing prices (also the unfilled one at a series start)."""
    flagged = fill_limited(df, max_consecutive_days=max_consecutive_days, run_lengths=True)
    runs = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"_run_{c}").isNotNull(),
                    F.struct(F.lit(c).alias("column"), F.col(f"_run_{c}").cast("int").alias("consecutive_days")),
                )
                for c in PRICES
            ]
        )
    )
    return flagged.select("symbol", F.col("date").alias("start_date"), F.inline(runs))


def _middle(values: Column) -> Column:
    """Median of an array; its NULLs do not count."""
    def of(x: Column) -> Column:
        return (F.get(x, F.floor((F.size(x) - 1) / 2)) + F.get(x, F.floor(F.size(x) / 2))) / 2.0

    # One element, so that the sorted array is made once.
    return F.get(F.transform(F.array(F.array_sort(F.array_compact(values))), of), F.lit(0))


def _fold_medians(todo: Column) -> Column:
    """[(at, v)] for missing volumes [(at, near)] in order; a filled value feeds the medians of later rows near it."""
    def step(done: Column, x: Column) -> Column:
        fed = F.transform(F.filter(done, lambda d: d["at"] >= x["at"] - 5), lambda d: d["v"])
        return F.concat(done, F.array(F.struct(x["at"].alias("at"), _middle(F.concat(x["near"], fed)).alias("v"))))

    return F.aggregate(todo, F.lit(None).cast("array<struct<at:int,v:double>>"), lambda done, x: step(F.coalesce(done, F.expr("CAST(array() AS array<struct<at:int,v:double>>)")), x))


def fill_volume(df: DataFrame, *, volume_strategy: str = "median", flag: str | None = None) -> DataFrame:
    """Missing volume: median of the known volumes five rows either side, or the last known one.

    A missing volume with another one at most five rows before it depends on that fill, so the fills of a chain are folded
    in order: once for each chain, at the last row before the next chain's, in the exchange by symbol that all cleaning
    shares.
    """
    w = series_window()
    if volume_strategy == "forward_fill":
        return df.withColumn("volume", F.coalesce("volume", F.last("volume", True).over(upto(w))))
    if volume_strategy != "median":
        raise ValueError("volume_strategy must be 'median' or 'forward_fill'")
    null = F.col("volume").isNull()
    marked = df.withColumns(
        {
            "_at": F.row_number().over(w),
            "_starts": null & (F.count_if(null).over(w.rowsBetween(-5, -1)) == 0),
            "_near": F.collect_list("volume").over(w.rowsBetween(-5, 5)),
        }
    )
    chains = Window.partitionBy("symbol", "_chain")
    whole = chains.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    todo = F.collect_list(F.when(null, F.struct(F.col("_at").alias("at"), F.col("_near").alias("near")))).over(whole)
    chained = marked.withColumn("_chain", F.count_if("_starts").over(upto(w))).withColumns(
        {"_todo": todo, "_last": F.lead("_at").over(chains.orderBy("_at")).isNull()}
    )
    folded = chained.withColumn("_fold", F.when(F.col("_last") & (F.size("_todo") > 0), _fold_medians(F.col("_todo"))))
    folded = folded.withColumn("_fold", F.first("_fold", True).over(whole))
    mine = F.get(F.filter("_fold", lambda d: d["at"] == F.col("_at")), F.lit(0))["v"]
    out = folded.withColumn("_value", F.when(null, mine).otherwise(F.col("volume")))
    if flag:
        out = out.withColumn(flag, F.when(null & F.col("_value").isNotNull(), 1).otherwise(0))
    return out.withColumn("volume", F.col("_value")).drop("_value", "_at", "_near", "_starts", "_chain", "_todo", "_last", "_fold")


# Correcting


def fix_ohlc(df: DataFrame, *, fix_method: str = "linear_interpolation", flag: str | None = None) -> DataFrame:
    """Rebuild bars with broken order from open and close (or drop them with ``fix_method='exclude'``).

    With m = open/4 + 3*close/4: open and low become the smallest of (open, m, close),
    close and high the largest.
    """
    df = df.withColumn("_broken", violation_list())
    bad = F.size("_broken") > 0
    if fix_method == "exclude":
        df = df.where(~bad)
    elif fix_method == "linear_interpolation":
        low = "least(open, 0.25D * open + 0.75D * close, close)"
        high = "greatest(open, 0.25D * open + 0.75D * close, close)"
        fixed = {"open": low, "high": high, "low": low, "close": high}
        df = df.withColumns({c: F.expr(f"IF(size(_broken) > 0, {e}, {c})") for c, e in fixed.items()})
    else:
        raise ValueError("fix_method must be 'linear_interpolation' or 'exclude'")
    return df.withColumnRenamed("_broken", flag) if flag else df.drop("_broken")


def _with_score(df: DataFrame) -> DataFrame:
    """Add ``confirmations``: wide range, high volume and large move each confirm a spike once."""
    w = series_window()
    df = df.withColumns(
        {
            "_spread": F.coalesce(ratio(F.col("high") - F.col("low"), F.col("low")), F.lit(0.0)),
            "_vma": roll(F.avg, "volume", 20, w),
            "_len": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    size = F.abs("daily_return")
    points = (
        F.when(F.col("_spread") > size * 0.5, 1).otherwise(0)
        + F.when((F.col("_len") > 20) & (ratio(F.col("volume"), F.col("_vma")) > 1.5), 1).otherwise(0)
        + F.when(size > 0.3, 1).otherwise(0)
    )
    scored = F.when(F.col("daily_return").isNotNull(), points)
    return df.withColumn("confirmations", scored).drop("_spread", "_vma", "_len")


def mark_spikes(df: DataFrame, *, threshold: float = 0.20) -> DataFrame:
    """Add ``previous_close`` and ``daily_return``, NULL on rows that are no spike."""
    prev, ret = spike_return(threshold)
    return df.withColumns({"_prev": prev, "daily_return": ret}).withColumn(
        "previous_close", F.when(F.col("daily_return").isNotNull(), F.col("_prev"))
    ).drop("_prev")


def confirm_spikes(df: DataFrame, *, threshold: float = 0.20, fix_method: str = "interpolation") -> DataFrame:
    """Every spike with its confirmations (0 to 3) and what happens to it."""
    rejected = "removed" if fix_method == "removal" else "interpolated"
    marked = _with_score(mark_spikes(df, threshold=threshold)).where(F.col("daily_return").isNotNull())
    action = F.when(F.col("confirmations") >= 3, "accepted").otherwise(rejected)
    return marked.select(
        "symbol", "date", "daily_return", "previous_close", "close", "confirmations", action.alias("action")
    )


def fix_spikes(df: DataFrame, *, fix_method: str = "interpolation") -> DataFrame:
    """Correct the marked spikes (``daily_return`` not NULL) with fewer than three confirmations.

    A rejected close becomes the mean of its neighbours; in a run of spikes the left
    neighbour is already corrected, which is the recurrence y[t] = y[t-1]/2 + next/2.
    First and last bar keep their value. ``spike_action`` says what was done.
    """
    w = series_window()
    df = _with_score(df)
    action = F.when(F.col("confirmations") >= 3, "accepted").when(
        F.col("confirmations").isNotNull(), "removed" if fix_method == "removal" else "interpolated"
    )
    df = df.withColumn("spike_action", action).drop("confirmations")
    if fix_method == "removal":
        return df.where(F.coalesce(F.col("spike_action") != "removed", F.lit(True)))
    df = df.withColumns(
        {
            "_at": F.row_number().over(w),
            "_before": F.lag("close").over(w),
            "_next": F.lead("close").over(w),
            "_inner": F.lag("date").over(w).isNotNull() & F.lead("date").over(w).isNotNull(),
        }
    )
    df = df.withColumn("_fix", F.coalesce((F.col("spike_action") == "interpolated") & F.col("_inner"), F.lit(False)))
    df = df.withColumn("_start", F.col("_fix") & ~F.coalesce(F.lag("_fix").over(w), F.lit(False)))
    df = df.withColumns(
        {
            "_run": F.count_if("_start").over(upto(w)),
            "_from": F.last(F.when(F.col("_start"), F.col("_at")), True).over(upto(w)),
        }
    )
    # Powers of two stay in range by cutting long runs; what lies two cuts back weighs 2**-512.
    step = F.col("_at") - F.col("_from")
    push = F.when(F.col("_start"), (F.col("_before") + F.col("_next")) / 2).when(F.col("_fix"), F.col("_next") / 2)
    df = df.withColumns({"_cut": F.floor(step / 512), "_age": step % 512})
    df = df.withColumn("_push", push * F.pow(F.lit(2.0), F.col("_age")))
    inside = Window.partitionBy("symbol", "_run", "_cut").orderBy("date")
    earlier = Window.partitionBy("symbol", "_run").orderBy("_cut").rangeBetween(-1, -1)
    df = df.withColumn("_here", F.sum("_push").over(upto(inside)))
    # The sum on the last row of a cut is its total. Built on the sums before it, this window
    # keeps their sort order.
    df = df.withColumn("_past", F.max_by("_here", "date").over(earlier) * 2.0**-512)
    df = df.withColumn(
        "_smooth", (F.col("_here") + F.coalesce(F.col("_past"), F.lit(0.0))) * F.pow(F.lit(0.5), F.col("_age"))
    )
    helpers = "_at _before _next _inner _fix _start _run _from _cut _age _push _here _past _smooth".split()
    return df.withColumns(
        {
            "close": F.when(F.col("_fix"), F.col("_smooth")).otherwise(F.col("close")),
            "high": F.when(F.col("_fix"), F.greatest("high", "_smooth")).otherwise(F.col("high")),
            "low": F.when(F.col("_fix"), F.least("low", "_smooth")).otherwise(F.col("low")),
        }
    ).drop(*helpers)


# Corporate actions


def _with_actions(df: DataFrame, actions: DataFrame, *, snap: bool) -> DataFrame:
    """Add ``_acts``: the actions that take effect on the bar, as (date, type, factor) structs.

    Actions travel packed per symbol. Without ``snap`` only those dated on a bar count;
    with it a dividend moves to the nearest bar at most two days away, the earlier on a tie.
    """
    packed = actions.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("date", "type", "factor", "amount"))).alias("_all")
    )
    w = series_window()
    df = df.withColumns({"_pd": F.lag("date").over(w), "_nd": F.lead("date").over(w)})
    df = df.join(packed, "symbol", "left")

    def lands(a: Column) -> Column:
        on_bar = a["date"] == F.col("date")
        if not snap:
            return on_bar
        off = F.abs(F.datediff(a["date"], F.col("date")))
        back = F.coalesce(F.abs(F.datediff(a["date"], F.col("_pd"))), F.lit(1 << 30))
        ahead = F.coalesce(F.abs(F.datediff(a["date"], F.col("_nd"))), F.lit(1 << 30))
        near = (a["type"] == "dividend") & (off <= 2) & (off < back) & (off <= ahead)
        return on_bar | near

    def scaled(a: Column) -> Column:
        paid = 1.0 + ratio(a["amount"], F.col("close"))
        factor = F.when(a["type"] == "split", a["factor"]).otherwise(paid)
        return F.struct(a["date"].alias("date"), a["type"].alias("type"), factor.alias("factor"))

    acts = F.filter(F.transform(F.filter("_all", lands), scaled), lambda a: a["factor"].isNotNull())
    return df.withColumn("_acts", acts).drop("_all", "_pd", "_nd")


def dividend_nearest(df: DataFrame, actions: DataFrame) -> DataFrame:
    """Each dividend with its nearest bar (at most two days off) and the adjustment factor."""
    near = _with_actions(df, actions.where("type = 'dividend'"), snap=True)
    return near.select(
        "symbol", F.col("date").alias("bar_date"), "close", F.inline("_acts")
    ).select("symbol", F.col("date").alias("dividend_date"), "bar_date", "close", "factor")


def _cumulative(df: DataFrame) -> DataFrame:
    """Add ``_own`` (factor of the bar's own actions) and ``_factor`` (own and all later ones)."""
    own = F.aggregate(
        F.coalesce("_acts", F.array().cast("array<struct<date:date,type:string,factor:double>>")),
        F.lit(1.0),
        lambda acc, a: acc * a["factor"],
    )
    latest_first = Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_own", own).withColumn("_factor", F.product("_own").over(latest_first))


def adjust_prices(df: DataFrame, actions: DataFrame, *, snap: bool = False, keep_counts: bool = False) -> DataFrame:
    """Divide prices up to and including each action's bar by its factor; volume stays.

    An action that is not dated on a bar is skipped unless ``snap`` is set.
    """
    if "adj_close" not in df.columns:
        df = df.withColumn("adj_close", F.col("close"))
    df = _cumulative(_with_actions(df, actions, snap=snap))
    df = df.withColumns({c: F.col(c) / F.col("_factor") for c in (*PRICES, "adj_close")})
    if keep_counts:
        df = df.withColumn("_adjusted", F.coalesce(F.size("_acts"), F.lit(0)))
    return df.drop("_acts", "_own", "_factor")


def adjustment_records(df: DataFrame, actions: DataFrame, *, snap: bool = False) -> DataFrame:
    """One row per applied action: factor, close before and after it."""
    one = _cumulative(_with_actions(df, actions, snap=snap)).where(F.size("_acts") > 0)
    # Later bars' actions are applied first; on one bar they follow their order in the list.
    later = F.col("_factor") / F.col("_own")
    rows = one.select("symbol", "date", "close", later.alias("_later"), "_acts", F.posexplode("_acts").alias("_i", "_a"))
    done = F.aggregate(F.slice("_acts", 1, F.col("_i")), F.lit(1.0), lambda acc, a: acc * a["factor"])
    before_close = F.col("close") / (F.col("_later") * done)
    return rows.select(
        "symbol",
        "date",
        F.col("_a.type").alias("type"),
        F.col("_a.factor").alias("factor"),
        before_close.alias("before_close"),
        (before_close / F.col("_a.factor")).alias("after_close"),
    )


# The whole run


def clean_steps(
    df: DataFrame,
    actions: DataFrame | None = None,
    *,
    max_forward_fill_days: int = 2,
    spike_threshold: float = 0.2,
    snap: bool = False,
) -> DataFrame:
    """Cleaned bars with audit columns (leading underscore, ``daily_return``, ``spike_action``).

    Spikes are those of the raw closes; a spike on a dropped row disappears with it.
    """
    df = mark_spikes(df, threshold=spike_threshold)
    df = fill_limited(df, max_consecutive_days=max_forward_fill_days, flags=True)
    df = fill_volume(df, flag="_fill_volume")
    df = fix_ohlc(df, flag="_broken")
    df = fix_spikes(df)
    if actions is not None:
        return adjust_prices(df, actions, snap=snap, keep_counts=True)
    return df.withColumn("_adjusted", F.lit(0))


def clean_bars(df: DataFrame, actions: DataFrame | None = None, **options) -> DataFrame:
    """Fill, repair, de-spike and adjust the bars of every symbol."""
    out = clean_steps(df, actions, **options)
    kept = ["symbol", "date", *OHLCV] + (["adj_close"] if "adj_close" in out.columns else [])
    return out.select(*kept)


def stasis_runs(df: DataFrame, *, min_days: int = 5) -> DataFrame:
    """Longest runs of equal known closes, at least ``min_days`` long."""
    w = series_window()
    known = df.where(F.col("close").isNotNull()).select("symbol", "date", "close")
    changed = F.coalesce((F.col("close") != F.lag("close").over(w)).cast("int"), F.lit(0))
    runs = known.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(upto(w)))
    return (
        runs.groupBy("symbol", "_run")
        .agg(
            F.min("date").alias("start_date"),
            F.max("date").alias("end_date"),
            F.count(F.lit(1)).alias("num_days"),
        )
        .where(F.col("num_days") >= min_days)
        .drop("_run")
    )


def detection_counts(df: DataFrame, *, spike_threshold: float = 0.2) -> DataFrame:
    """Per symbol: rows, dates and what the detectors find on the raw bars."""
    w = series_window()
    _, spike = spike_return(spike_threshold)
    cells = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in missing_reasons()[1:]), F.when(missing_reasons()[0].isNotNull(), 1).otherwise(0))
    rows = df.select(
        "symbol",
        "date",
        cells.alias("_missing"),
        F.datediff("date", F.lag("date").over(w)).alias("_gap"),
        spike.alias("_spike"),
        F.size(violation_list()).alias("_bad"),
    )
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("raw_data_rows"),
        F.min("date").alias("raw_start_date"),
        F.max("date").alias("raw_end_date"),
        F.sum("_missing").alias("missing_values_detected"),
        F.count_if(F.col("_gap") > 1).alias("date_gaps_detected"),
        F.count("_spike").alias("spikes_detected"),
        F.sum("_bad").alias("ohlc_violations_detected"),
    )


def correction_sums() -> dict[str, Column]:
    """Corrections per row of :func:`clean_steps`."""
    fills = F.col("_fill_volume")
    for c in PRICES:
        fills = fills + F.col(f"_fill_{c}")
    return {
        "forward_fills_applied": fills,
        "spikes_corrected": F.col("spike_action").isNotNull().cast("int"),
        "ohlc_corrections_applied": F.size("_broken"),
        "adjustments_applied": F.col("_adjusted"),
    }


def cleaning_report(
    df: DataFrame,
    actions: DataFrame | None = None,
    *,
    min_trading_days: int = 2500,
    min_completeness: float = 0.99,
    spike_threshold: float = 0.2,
    **options,
) -> DataFrame:
    """One row per symbol: detections, corrections, what is left, and the verdict.

    PASS needs every quality check. FAIL means too few rows or too many disordered bars;
    failing only the statistics or stasis check asks for a manual review.
    """
    from barloom.operators.quality import quality_report

    steps = clean_steps(df, actions, spike_threshold=spike_threshold, **options)
    cleaned = quality_report(
        steps, min_trading_days=min_trading_days, min_completeness=min_completeness, also=correction_sums()
    ).select(
        "symbol",
        *correction_sums(),
        F.col("total_rows").alias("cleaned_data_rows"),
        F.col("start_date").alias("cleaned_start_date"),
        F.col("end_date").alias("cleaned_end_date"),
        "overall_pass",
        "enough_days",
        "ordering_ok",
        "ordering_pct",
    )
    joined = detection_counts(df, spike_threshold=spike_threshold).join(cleaned, "symbol", "left")
    counts = "forward_fills_applied spikes_corrected ohlc_corrections_applied adjustments_applied cleaned_data_rows".split()
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    # A symbol without any row left has no aggregates: it fails the row check.
    passed = F.coalesce("overall_pass", F.lit(False))
    errors = F.when(F.coalesce("enough_days", F.lit(False)), 0).otherwise(1) + F.when(
        F.coalesce("ordering_ok", F.lit(False)), 0
    ).otherwise(1)
    return joined.withColumns(
        {
            "rows_excluded": F.col("raw_data_rows") - F.col("cleaned_data_rows"),
            "completeness_percent": F.round(F.coalesce(F.col("ordering_pct"), F.lit(0.0)) * 100, 2),
            "validation_passed": passed,
            "validation_errors": errors,
            "quality_status": F.when(passed, "PASS").when(errors > 0, "FAIL").otherwise("MANUAL_REVIEW"),
        }
    ).drop("overall_pass", "enough_days", "ordering_ok", "ordering_pct")


def cleaning_impact(report: DataFrame) -> DataFrame:
    """Totals of the cleaning reports of all symbols."""
    total = lambda c, name: F.sum(c).alias(name)
    return report.agg(
        F.count(F.lit(1)).alias("symbols"),
        total("raw_data_rows", "raw_rows"),
        total("cleaned_data_rows", "cleaned_rows"),
        total("forward_fills_applied", "forward_fills"),
        total("spikes_corrected", "spikes_corrected"),
        total("ohlc_corrections_applied", "ohlc_corrections"),
        total("adjustments_applied", "adjustments"),
        total("rows_excluded", "rows_removed"),
        total("missing_values_detected", "missing_values"),
        total("date_gaps_detected", "date_gaps"),
        F.avg("completeness_percent").alias("avg_completeness"),
    )


def transformation_log(
    df: DataFrame, actions: DataFrame | None = None, *, spike_threshold: float = 0.2, **options
) -> DataFrame:
    """Audit trail: one row per kind of change and bar (symbol, date, transformation_type, reason)."""
    steps = clean_steps(df, actions, spike_threshold=spike_threshold, **options)

    def event(cond: Column, kind: str, reason: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("transformation_type"), reason.alias("reason")))

    rows = F.array_compact(
        F.array(
            *[event(F.col(f"_fill_{c}") == 1, "forward_fill", F.lit(f"carried {c}")) for c in PRICES],
            event(F.col("_fill_volume") == 1, "volume_fill", F.lit("median of nearby rows")),
            event(F.size("_broken") > 0, "ohlc_correction", F.array_join("_broken", ",")),
            event(F.col("spike_action").isNotNull(), "spike_correction", F.col("spike_action")),
            event(F.col("_adjusted") > 0, "price_adjustment", F.col("_adjusted").cast("string")),
        )
    )
    return steps.select("symbol", "date", F.inline(rows))


def audit_totals(log: DataFrame) -> DataFrame:
    """All changes, and the symbols they touched, sorted; one row."""
    return log.agg(
        F.count(F.lit(1)).alias("changes"),
        F.countDistinct("symbol").alias("symbols"),
        F.array_sort(F.collect_set("symbol")).alias("symbol_list"),
    )


def audit_stats(log: DataFrame) -> DataFrame:
    """Changes and distinct symbols per kind of change."""
    return log.groupBy("transformation_type").agg(
        F.count(F.lit(1)).alias("changes"),
        F.countDistinct("symbol").alias("symbols"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
