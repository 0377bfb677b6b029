"""Registered queries: detection, correction, adjustment and quality of bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import clean, quality
from barloom.plans.entries import Entry, entry, same
from barloom.plans.oracle import W, roll, sql
from barloom.sources import bars as src
from barloom.sources.bars import OHLCV, PRICES

MIN_DAYS = 1500


def _on_dirty(op):
    return lambda spark, sf: op(src.bars_dirty(spark, sf))


_BAD_ORDER = {
    "high_lt_close": "high < close",
    "close_lt_low": "close < low",
    "low_lt_open": "open < low",
    "high_lt_open": "high < open",
    "high_lt_low": "high < low",
}
_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in PRICES)
_ANY_BAD = f"({_KNOWN} AND ({' OR '.join(_BAD_ORDER.values())}))"
_COUNT_BAD = " + ".join(f"(CASE WHEN {_KNOWN} AND {p} THEN 1 ELSE 0 END)" for p in _BAD_ORDER.values())
_ORDERED = "low <= open AND open <= high AND low <= close AND close <= high AND low <= high"


def _fills(source: str) -> dict[str, str]:
    """Four column stages: mark null runs, drop the long ones, carry over the short ones."""
    out: dict[str, str] = {}
    cur = source
    for c in PRICES:
        out[f"i_{c}"] = (
            f"SELECT *, count({c}) OVER ({W} ROWS UNBOUNDED PRECEDING) AS isl FROM {cur}"
        )
        out[f"r_{c}"] = (
            f"SELECT *, count(*) FILTER (WHERE {c} IS NULL) OVER (PARTITION BY symbol, isl) AS rl, "
            f"max({c}) OVER (PARTITION BY symbol, isl) AS carry, "
            f"row_number() OVER (PARTITION BY symbol, isl ORDER BY date) AS k FROM i_{c}"
        )
        rest = ", ".join(x for x in OHLCV if x != c)
        extra = "" if cur == source else ", nf, runs"
        nf = "0" if cur == source else "nf"
        runs = "[]::STRUCT(c VARCHAR, n BIGINT)[]" if cur == source else "runs"
        del extra
        start = f"({c} IS NULL AND k = CASE WHEN isl = 0 THEN 1 ELSE 2 END)"
        keep = "" if source != "raw" else ", sret, sprev"
        out[f"f_{c}"] = (
            f"SELECT symbol, date, coalesce({c}, carry) AS {c}, {rest}{keep}, "
            f"{nf} + CASE WHEN {c} IS NULL AND carry IS NOT NULL THEN 1 ELSE 0 END AS nf, "
            f"CASE WHEN {start} THEN list_append({runs}, {{'c': '{c}', 'n': rl}}) ELSE {runs} END AS runs "
            f"FROM r_{c} WHERE {c} IS NOT NULL OR rl <= 2"
        )
        cur = f"f_{c}"
    return out


PASSES = 8


def _volume_steps(source: str) -> dict[str, str]:
    """Volume medians in order: each pass fills the missing values that no longer have one in the five rows before.

    ``vol`` is the result.
    """
    out, cur = {}, source
    flag = ", CASE WHEN volume IS NULL THEN 1 ELSE 0 END AS vf"
    for i in range(PASSES):
        out[f"vol{i}"] = (
            f"SELECT * EXCLUDE (volume), CASE WHEN volume IS NULL AND count(*) FILTER (WHERE volume IS NULL) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 0 "
            f"THEN quantile_cont(volume, 0.5) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) ELSE volume END AS volume{flag if i == 0 else ''} FROM {cur}"
        )
        cur = f"vol{i}"
    return {**out, "vol": f"SELECT * FROM {cur}"}


def _fix_ohlc(source: str, keep: str = "") -> str:
    m = "(0.25e0 * open + 0.75e0 * close)"
    lo, hi = f"least(open, {m}, close)", f"greatest(open, {m}, close)"
    return (
        f"SELECT symbol, date, CASE WHEN {_ANY_BAD} THEN {lo} ELSE open END AS open, "
        f"CASE WHEN {_ANY_BAD} THEN {hi} ELSE high END AS high, "
        f"CASE WHEN {_ANY_BAD} THEN {lo} ELSE low END AS low, "
        f"CASE WHEN {_ANY_BAD} THEN {hi} ELSE close END AS close, volume, {_COUNT_BAD} AS nbad{keep} FROM {source}"
    )


_SPIKE_SRC = f"""SELECT *, CASE WHEN abs(close / NULLIF(pc, 0) - 1) > 0.2 THEN close / NULLIF(pc, 0) - 1 END AS sret,
  CASE WHEN abs(close / NULLIF(pc, 0) - 1) > 0.2 THEN pc END AS sprev
  FROM (SELECT *, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc FROM {{src}})"""


def _spike_steps(source: str, keep: str = "") -> dict[str, str]:
    """Score, reject, and smooth runs of rejected spikes with the closed form of the recurrence."""
    return {
        "scored": f"""SELECT *, CASE WHEN sret IS NOT NULL THEN
            (CASE WHEN coalesce((high - low) / NULLIF(low, 0), 0) > abs(sret) * 0.5 THEN 1 ELSE 0 END)
          + (CASE WHEN count(*) OVER (PARTITION BY symbol) > 20 AND volume / NULLIF({roll('avg', 'volume', 20)}, 0) > 1.5 THEN 1 ELSE 0 END)
          + (CASE WHEN abs(sret) > 0.3 THEN 1 ELSE 0 END) END AS pts FROM {source}""",
        "acted": f"""SELECT *, CASE WHEN pts >= 3 THEN 'accepted' WHEN pts IS NOT NULL THEN 'interpolated' END AS action,
          coalesce(pts < 3, false) AND lag(date) OVER ({W}) IS NOT NULL AND lead(date) OVER ({W}) IS NOT NULL AS fix,
          lag(close) OVER ({W}) AS bc, lead(close) OVER ({W}) AS nc, row_number() OVER ({W}) AS n FROM scored""",
        "islands": f"""SELECT *, n - count(*) FILTER (WHERE fix) OVER ({W} ROWS UNBOUNDED PRECEDING) AS isl FROM acted""",
        "smoothed": """SELECT a.symbol, a.date, sum(CASE WHEN b.n = f.n0 THEN (b.bc + b.nc) / 2 ELSE b.nc / 2 END * pow(0.5e0, (a.n - b.n)::DOUBLE)) AS y
          FROM islands a JOIN islands b ON a.symbol = b.symbol AND a.isl = b.isl AND b.fix AND b.n <= a.n
          JOIN (SELECT symbol, isl, min(n) AS n0 FROM islands WHERE fix GROUP BY symbol, isl) f ON f.symbol = a.symbol AND f.isl = a.isl
          WHERE a.fix GROUP BY a.symbol, a.date""",
        "despiked": f"""SELECT i.symbol, i.date, open, CASE WHEN fix THEN greatest(high, y) ELSE high END AS high,
          CASE WHEN fix THEN least(low, y) ELSE low END AS low, CASE WHEN fix THEN y ELSE close END AS close, volume, action{keep}
          FROM islands i LEFT JOIN smoothed s ON i.symbol = s.symbol AND i.date = s.date""",
    }


def _adjust_steps(source: str, keep: str = "") -> dict[str, str]:
    return {
        "acts": f"""SELECT b.symbol, b.date, a.type, CASE WHEN a.type = 'split' THEN a.factor ELSE 1 + a.amount / NULLIF(b.close, 0) END AS f
          FROM {source} b JOIN actions a ON a.symbol = b.symbol AND a.date = b.date""",
        "per_bar": "SELECT symbol, date, product(f) AS own, count(*) AS na FROM acts GROUP BY symbol, date",
        "cum": f"""SELECT b.*, coalesce(p.own, 1) AS own, coalesce(p.na, 0) AS na, product(coalesce(p.own, 1)) OVER
          (PARTITION BY b.symbol ORDER BY b.date DESC ROWS UNBOUNDED PRECEDING) AS cf FROM {source} b LEFT JOIN per_bar p ON b.symbol = p.symbol AND b.date = p.date""",
        "adjusted": f"""SELECT symbol, date, open / cf AS open, high / cf AS high, low / cf AS low, close / cf AS close,
          close / cf AS adj_close, volume, na{keep} FROM cum""",
    }


_CLEAN = {
    "raw": _SPIKE_SRC.format(src="dirty"),
    **_fills("raw"),
    **_volume_steps("f_close"),
    "ohlc": _fix_ohlc("vol", ", sret, nf, vf"),
    **_spike_steps("ohlc", ", nf, vf, nbad"),
    **_adjust_steps("despiked", ", nf, vf, nbad, action"),
}

_QUALITY = {
    "q_runs": f"""SELECT *, sum(coalesce((close <> pk)::INT, 0)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM
      (SELECT *, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk FROM {{src}})""",
    "q_per_run": f"SELECT symbol, run, count(*) AS n, count(close) AS known, count(*) FILTER (WHERE {_ORDERED}) AS ok, min(volume) AS mv FROM q_runs GROUP BY symbol, run",
    "quality": f"""SELECT *, enough_days AND ordering_ok AND stats_ok AND stasis_ok AS overall_pass FROM (
      SELECT symbol, CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(ok) AS BIGINT) AS valid_bars, count(*) FILTER (WHERE known >= 5) AS stasis_runs,
      coalesce(min(mv) >= 0, true) AS stats_ok, sum(n) >= {MIN_DAYS} AS enough_days, sum(ok) / sum(n) AS ordering_pct, count(*) FILTER (WHERE known >= 5) = 0 AS stasis_ok,
      sum(ok) / sum(n) >= 0.99e0 AS ordering_ok FROM q_per_run GROUP BY symbol)""",
}


def _quality_of(source: str) -> dict[str, str]:
    return {k: v.format(src=source) if k == "q_runs" else v for k, v in _QUALITY.items()}


_MISSING_CELLS = " UNION ALL ".join(
    [
        f"SELECT symbol, date, '{c}' AS \"column\", CASE WHEN {c} IS NULL THEN 'NaN' WHEN {c} = 0 THEN 'zero' WHEN {c} < 0 THEN 'negative' END AS reason FROM dirty"
        for c in PRICES
    ]
    + ["SELECT symbol, date, 'volume', CASE WHEN volume IS NULL THEN 'NaN' WHEN volume = 0 THEN 'zero' END FROM dirty"]
)
_REPORT = {
    "gaps": f"SELECT symbol, lag(date) OVER ({W}) AS start_date, date AS end_date, date - lag(date) OVER ({W}) AS gap_days FROM dirty",
    "mis": _MISSING_CELLS,
    "det": f"""SELECT r.symbol, count(*) AS raw_data_rows, min(date) AS raw_start_date, max(date) AS raw_end_date, count(sret) AS spikes_detected,
        CAST(sum({_COUNT_BAD}) AS BIGINT) AS ohlc_violations_detected,
        (SELECT count(*) FROM mis m WHERE m.symbol = r.symbol AND reason IS NOT NULL) AS missing_values_detected,
        (SELECT count(*) FROM gaps g WHERE g.symbol = r.symbol AND gap_days > 1) AS date_gaps_detected FROM raw r GROUP BY r.symbol""",
    "cor": """SELECT symbol, CAST(sum(nf + vf) AS BIGINT) AS forward_fills_applied, count(action) AS spikes_corrected, CAST(sum(nbad) AS BIGINT) AS ohlc_corrections_applied,
        CAST(sum(na) AS BIGINT) AS adjustments_applied, count(*) AS cleaned_data_rows, min(date) AS cleaned_start_date, max(date) AS cleaned_end_date FROM adjusted GROUP BY symbol""",
    "report": """SELECT d.*, c.* EXCLUDE (symbol), raw_data_rows - cleaned_data_rows AS rows_excluded, round(ordering_pct * 100, 2) AS completeness_percent,
        overall_pass AS validation_passed, CAST((NOT enough_days)::INT + (NOT ordering_ok)::INT AS BIGINT) AS validation_errors,
        CASE WHEN overall_pass THEN 'PASS' WHEN NOT enough_days OR NOT ordering_ok THEN 'FAIL' ELSE 'MANUAL_REVIEW' END AS quality_status
        FROM det d JOIN cor c USING (symbol) JOIN quality USING (symbol)""",
}
_REPORT_KEYS = (
    "symbol raw_data_rows raw_start_date raw_end_date missing_values_detected date_gaps_detected spikes_detected ohlc_violations_detected "
    "forward_fills_applied spikes_corrected ohlc_corrections_applied adjustments_applied cleaned_data_rows cleaned_start_date cleaned_end_date "
    "rows_excluded validation_passed validation_errors quality_status"
).split()


def _report(spark, sf):
    return clean.cleaning_report(
        src.bars_dirty(spark, sf), src.corporate_actions(spark, sf), min_trading_days=MIN_DAYS
    )


def _report_sql(body: str) -> str:
    return sql(body, "dirty", "actions", **_CLEAN, **_quality_of("adjusted"), **_REPORT)


def _excluded(spark, sf):
    """Symbols whose raw bars fail the row count or hold negative prices."""
    bad = src.bars_dirty(spark, sf).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("low") < 0).alias("neg")
    )
    return bad.where((F.col("n") < MIN_DAYS) | (F.col("neg") > 13)).select(
        "symbol", F.when(F.col("n") < MIN_DAYS, "too few rows").otherwise("negative prices").alias("reason")
    )


_EXCLUDED = f"""SELECT symbol, CASE WHEN count(*) < {MIN_DAYS} THEN 'too few rows' ELSE 'negative prices' END AS reason
  FROM dirty GROUP BY symbol HAVING count(*) < {MIN_DAYS} OR count(*) FILTER (WHERE low < 0) > 13"""


def _quality(spark, sf):
    return quality.quality_report(src.bars_dirty(spark, sf), min_trading_days=MIN_DAYS)


def _log(spark, sf):
    return clean.transformation_log(src.bars_dirty(spark, sf), src.corporate_actions(spark, sf))


_PRICE_DIGITS = {**same("open high low close", 10), "volume": 6}

ENTRIES: dict[str, Entry] = {
    "detect_missing": entry(
        _on_dirty(clean.detect_missing),
        sql('SELECT * FROM m WHERE reason IS NOT NULL', "dirty", m=_MISSING_CELLS),
        keys=("symbol", "date", "column", "reason"),
    ),
    "date_gaps": entry(
        _on_dirty(clean.date_gaps),
        sql("SELECT *, 'missing' AS reason FROM gaps WHERE gap_days > 1", "dirty", gaps=_REPORT["gaps"]),
        keys=("symbol", "start_date", "end_date", "gap_days", "reason"),
    ),
    "unfillable_gaps": entry(
        _on_dirty(clean.unfillable_gaps),
        sql("SELECT * FROM gaps WHERE gap_days > 2", "dirty", gaps=_REPORT["gaps"]),
        keys=("symbol", "start_date", "end_date", "gap_days"),
    ),
    "spikes": entry(
        _on_dirty(clean.detect_spikes),
        sql(
            "SELECT symbol, date, 'close' AS \"column\", sret AS daily_return, sprev AS previous_close, close AS current_value, "
            "CASE WHEN abs(sret) > 0.5 THEN 'high' WHEN abs(sret) > 0.3 THEN 'medium' ELSE 'low' END AS severity FROM raw WHERE sret IS NOT NULL",
            "dirty",
            raw=_CLEAN["raw"],
        ),
        keys=("symbol", "date", "column", "severity"),
        digits=same("daily_return previous_close current_value", 8),
    ),
    "severity_filter": entry(
        lambda spark, sf: clean.by_severity(clean.detect_spikes(src.bars_dirty(spark, sf)), "medium"),
        sql(
            "SELECT symbol, date, sret AS daily_return FROM raw WHERE abs(sret) > 0.3 AND abs(sret) <= 0.5",
            "dirty",
            raw=_CLEAN["raw"],
        ),
        digits={"daily_return": 8},
    ),
    "spike_confirm": entry(
        _on_dirty(clean.confirm_spikes),
        sql(
            "SELECT symbol, date, CAST(pts AS BIGINT) AS confirmations, action, sret AS daily_return FROM acted WHERE sret IS NOT NULL",
            "dirty",
            raw=_CLEAN["raw"],
            **_spike_steps("raw"),
        ),
        keys=("symbol", "date", "confirmations", "action"),
        digits={"daily_return": 8},
    ),
    "ohlc_violations": entry(
        _on_dirty(clean.ohlc_violations),
        sql(
            " UNION ALL ".join(
                f"SELECT symbol, date, '{name}' AS violation_type FROM dirty WHERE {_KNOWN} AND {cond}"
                for name, cond in _BAD_ORDER.items()
            ),
            "dirty",
        ),
        keys=("symbol", "date", "violation_type"),
    ),
    "price_ordering": entry(
        _on_dirty(clean.price_ordering),
        sql(f"SELECT symbol, count(*) FILTER (WHERE {_ORDERED}) AS valid_bars, count(*) AS total_bars FROM dirty GROUP BY symbol", "dirty"),
        keys=("symbol", "valid_bars", "total_bars"),
    ),
    "ffill_limited": entry(
        _on_dirty(clean.fill_limited),
        sql("SELECT symbol, date, open, high, low, close FROM f_close", "dirty", **_fills("dirty")),
        digits=same("open high low close", 10),
    ),
    "fill_runs": entry(
        _on_dirty(clean.fill_runs),
        sql(
            "SELECT symbol, date AS start_date, u.c AS \"column\", u.n AS consecutive_days FROM (SELECT symbol, date, unnest(runs) AS u FROM f_close)",
            "dirty",
            **_fills("dirty"),
        ),
        keys=("symbol", "start_date", "column", "consecutive_days"),
    ),
    "volume_fill": entry(
        _on_dirty(lambda df: clean.fill_volume(df)),
        sql("SELECT symbol, date, volume FROM vol", "dirty", **_volume_steps("dirty")),
        digits={"volume": 6},
    ),
    "ohlc_fix": entry(
        _on_dirty(clean.fix_ohlc),
        sql("SELECT * FROM fixed", "dirty", fixed=_fix_ohlc("dirty")),
        digits=_PRICE_DIGITS,
    ),
    "spike_fix": entry(
        lambda spark, sf: clean.fix_spikes(clean.mark_spikes(src.bars(spark, sf))).withColumn(
            "spike_action", F.coalesce("spike_action", F.lit("none"))
        ),
        sql(
            "SELECT symbol, date, coalesce(action, 'none') AS spike_action, open, high, low, close, volume FROM despiked",
            "bars",
            raw=_SPIKE_SRC.format(src="bars"),
            **_spike_steps("raw"),
        ),
        keys=("symbol", "date", "spike_action"),
        digits={**same("open high low close", 11), "volume": 6},
    ),
    "dividend_nearest": entry(
        lambda spark, sf: clean.dividend_nearest(src.bars(spark, sf), src.corporate_actions(spark, sf)),
        sql(
            "SELECT symbol, dividend_date, bar_date, close, 1 + amount / close AS factor FROM c WHERE rk = 1",
            "bars",
            "actions",
            c="SELECT a.symbol, a.date AS dividend_date, b.date AS bar_date, close, amount, row_number() OVER (PARTITION BY a.symbol, a.date, a.amount ORDER BY abs(a.date - b.date), b.date) AS rk "
            "FROM actions a JOIN bars b ON a.symbol = b.symbol AND abs(a.date - b.date) <= 2 WHERE a.type = 'dividend'",
        ),
        keys=("symbol", "dividend_date", "bar_date"),
        digits={"close": 8, "factor": 8},
    ),
    "adjust_prices": entry(
        lambda spark, sf: clean.adjust_prices(src.bars(spark, sf), src.corporate_actions(spark, sf)),
        sql("SELECT * FROM adjusted", "bars", "actions", **_adjust_steps("bars")),
        digits={**same("open high low close adj_close", 6), "volume": 6},
    ),
    "adjustment_records": entry(
        lambda spark, sf: clean.adjustment_records(src.bars(spark, sf), src.corporate_actions(spark, sf)),
        sql(
            "SELECT symbol, date, type, f AS factor, close / (cf / own * coalesce(done, 1)) AS before_close, close / (cf / own * coalesce(done, 1) * f) AS after_close FROM o",
            "bars",
            "actions",
            **_adjust_steps("bars"),
            o="SELECT a.*, c.close, c.cf, c.own, product(a.f) OVER (PARTITION BY a.symbol, a.date ORDER BY a.type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM acts a JOIN cum c ON a.symbol = c.symbol AND a.date = c.date",
        ),
        keys=("symbol", "date", "type"),
        digits=same("factor before_close after_close"),
    ),
    "action_range": entry(
        lambda spark, sf: clean._cumulative(
            clean._with_actions(src.bars(spark, sf), src.corporate_actions(spark, sf), snap=False)
        ).withColumnRenamed("_factor", "cumulative_factor"),
        sql(
            "SELECT b.symbol, b.date, coalesce(exp(sum(ln(a.f))), 1) AS cumulative_factor FROM bars b LEFT JOIN acts a ON a.symbol = b.symbol AND a.date >= b.date GROUP BY b.symbol, b.date",
            "bars",
            "actions",
            **_adjust_steps("bars"),
        ),
        digits={"cumulative_factor": 6},
    ),
    "clean_bars": entry(
        lambda spark, sf: clean.clean_bars(src.bars_dirty(spark, sf), src.corporate_actions(spark, sf)),
        sql("SELECT * FROM adjusted", "dirty", "actions", **_CLEAN),
        digits={**same("open high low close adj_close", 6), "volume": 6},
    ),
    "cleaning_report": entry(
        _report,
        _report_sql("SELECT * FROM report"),
        keys=_REPORT_KEYS,
        digits={"completeness_percent": 2},
    ),
    "cleaning_impact": entry(
        lambda spark, sf: clean.cleaning_impact(_report(spark, sf)),
        _report_sql(
            "SELECT count(*) AS symbols, CAST(sum(raw_data_rows) AS BIGINT) AS raw_rows, CAST(sum(cleaned_data_rows) AS BIGINT) AS cleaned_rows, CAST(sum(forward_fills_applied) AS BIGINT) AS forward_fills, "
            "CAST(sum(spikes_corrected) AS BIGINT) AS spikes_corrected, CAST(sum(ohlc_corrections_applied) AS BIGINT) AS ohlc_corrections, CAST(sum(adjustments_applied) AS BIGINT) AS adjustments, "
            "CAST(sum(rows_excluded) AS BIGINT) AS rows_removed, CAST(sum(missing_values_detected) AS BIGINT) AS missing_values, CAST(sum(date_gaps_detected) AS BIGINT) AS date_gaps, avg(completeness_percent) AS avg_completeness FROM report"
        ),
        keys="symbols raw_rows cleaned_rows forward_fills spikes_corrected ohlc_corrections adjustments rows_removed missing_values date_gaps".split(),
        digits={"avg_completeness": 6},
    ),
    "audit_totals": entry(
        lambda spark, sf: clean.audit_totals(_log(spark, sf)).withColumn("symbol_list", F.array_join("symbol_list", ",")),
        _report_sql(
            "SELECT count(*) AS changes, count(DISTINCT symbol) AS symbols, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbol_list FROM ("
            "SELECT symbol FROM (SELECT symbol, unnest(range(nf)) FROM adjusted) UNION ALL SELECT symbol FROM adjusted WHERE vf = 1 UNION ALL SELECT symbol FROM adjusted WHERE nbad > 0 "
            "UNION ALL SELECT symbol FROM adjusted WHERE action IS NOT NULL UNION ALL SELECT symbol FROM adjusted WHERE na > 0)"
        ),
        keys=("changes", "symbols", "symbol_list"),
    ),
    "audit_stats": entry(
        lambda spark, sf: clean.audit_stats(_log(spark, sf)),
        _report_sql(
            "SELECT t AS transformation_type, count(*) AS changes, count(DISTINCT symbol) AS symbols, min(date) AS first_date, max(date) AS last_date FROM ("
            "SELECT symbol, date, 'forward_fill' AS t FROM (SELECT symbol, date, unnest(range(nf)) FROM adjusted) "
            "UNION ALL SELECT symbol, date, 'volume_fill' FROM adjusted WHERE vf = 1 UNION ALL SELECT symbol, date, 'ohlc_correction' FROM adjusted WHERE nbad > 0 "
            "UNION ALL SELECT symbol, date, 'spike_correction' FROM adjusted WHERE action IS NOT NULL UNION ALL SELECT symbol, date, 'price_adjustment' FROM adjusted WHERE na > 0) GROUP BY t"
        ),
        keys=("transformation_type", "changes", "symbols", "first_date", "last_date"),
    ),
    "price_stasis": entry(
        lambda spark, sf: clean.stasis_runs(
            src.bars(spark, sf).withColumn("close", F.round(F.col("close") / 40)), min_days=3
        ),
        sql(
            "SELECT symbol, min(date) AS start_date, max(date) AS end_date, count(*) AS num_days FROM r GROUP BY symbol, run HAVING count(*) >= 3",
            "bars",
            c=f"SELECT symbol, date, round(close / 40) AS close FROM bars",
            d=f"SELECT *, coalesce((close <> lag(close) OVER ({W}))::INT, 0) AS ch FROM c",
            r=f"SELECT *, sum(ch) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM d",
        ),
        keys=("symbol", "start_date", "end_date", "num_days"),
    ),
    "column_stats": entry(
        _on_dirty(quality.column_stats),
        sql(
            " UNION ALL ".join(
                f"SELECT symbol, '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS null_count, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, stddev_samp({c}) AS std FROM dirty GROUP BY symbol"
                for c in OHLCV
            ),
            "dirty",
        ),
        keys=("symbol", "column", "count", "null_count"),
        digits={**same("min max median", 8), **same("mean std", 6)},
    ),
    "stats_check": entry(
        _on_dirty(quality.stats_check),
        sql("SELECT symbol, coalesce(min(volume) < 0, false) AS negative_volume, NOT coalesce(min(volume) < 0, false) AS stats_ok FROM dirty GROUP BY symbol", "dirty"),
        keys=("symbol", "negative_volume", "stats_ok"),
    ),
    "quality_report": entry(
        _quality,
        sql("SELECT * FROM quality", "dirty", **_quality_of("dirty")),
        keys="symbol total_rows valid_bars stasis_runs stats_ok enough_days stasis_ok ordering_ok overall_pass".split(),
        digits={"ordering_pct": 8},
    ),
    "validation_summary": entry(
        lambda spark, sf: quality.validation_summary(
            quality.exclude_symbols(_quality(spark, sf), _excluded(spark, sf)), _excluded(spark, sf)
        ),
        sql(
            "SELECT count(*) + (SELECT count(*) FROM ex) AS total_symbols, count(*) FILTER (WHERE overall_pass) AS symbols_passed, (SELECT count(*) FROM ex) AS symbols_excluded, "
            "count(*) FILTER (WHERE NOT overall_pass) AS symbols_manual_review FROM quality WHERE symbol NOT IN (SELECT symbol FROM ex)",
            "dirty",
            ex=_EXCLUDED,
            **_quality_of("dirty"),
        ),
        keys="total_symbols symbols_passed symbols_excluded symbols_manual_review".split(),
    ),
    "review_flags": entry(
        lambda spark, sf: quality.review_flags(_quality(spark, sf)),
        sql(
            "SELECT symbol, overall_pass AS passed, round(ordering_pct * 100, 2) AS completeness_percent, concat_ws(',', CASE WHEN NOT enough_days THEN 'min_trading_days' END, "
            "CASE WHEN NOT ordering_ok THEN 'ohlc_relationships' END, CASE WHEN NOT stats_ok THEN 'statistics' END, CASE WHEN NOT stasis_ok THEN 'price_stasis' END) AS failed_checks FROM quality",
            "dirty",
            **_quality_of("dirty"),
        ),
        keys=("symbol", "passed", "failed_checks"),
        digits={"completeness_percent": 2},
    ),
    "exclude_symbols": entry(
        lambda spark, sf: quality.exclude_symbols(src.bars_dirty(spark, sf), _excluded(spark, sf)),
        sql("SELECT symbol, date, close FROM dirty WHERE symbol NOT IN (SELECT symbol FROM ex)", "dirty", ex=_EXCLUDED),
        digits={"close": 8},
    ),
    "exclusion_summary": entry(
        lambda spark, sf: quality.exclusion_summary(_excluded(spark, sf)).withColumn(
            "symbol_list", F.array_join("symbol_list", ",")
        ),
        sql("SELECT reason, count(*) AS symbols, string_agg(symbol, ',' ORDER BY symbol) AS symbol_list FROM ex GROUP BY reason", "dirty", ex=_EXCLUDED),
        keys=("reason", "symbols", "symbol_list"),
    ),
    "log_price_guard": entry(
        lambda spark, sf: quality.log_price_guard(
            clean.fill_limited(src.bars_dirty(spark, sf)).withColumn(
                "close", F.when((src.brand_no() % 4 == 0) & (F.dayofyear("date") == 100), 0.0).otherwise(F.col("close"))
            )
        ),
        sql(
            "SELECT symbol, date, ln(close) AS log_close FROM z WHERE symbol NOT IN (SELECT symbol FROM z WHERE close IS NULL OR close <= 0)",
            "dirty",
            **_fills("dirty"),
            z="SELECT symbol, date, CASE WHEN CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS BIGINT) % 4 = 0 AND dayofyear(date) = 100 THEN 0 ELSE close END AS close FROM f_close",
        ),
        digits={"log_close": 8},
    ),
    "error_rollup": entry(
        lambda spark, sf: quality.error_rollup(quality.quality_events(_quality(spark, sf))),
        sql(
            "SELECT error_type, severity, action, count(*) AS events, count(DISTINCT symbol) AS affected_symbols FROM ("
            "SELECT symbol, 'InsufficientDataError' AS error_type, 'error' AS severity, 'skip_symbol' AS action FROM quality WHERE NOT enough_days "
            "UNION ALL SELECT symbol, 'DataQualityError', 'warning', 'continue' FROM quality WHERE NOT ordering_ok "
            "UNION ALL SELECT symbol, 'DataQualityError', 'error', 'skip_symbol' FROM quality WHERE NOT stats_ok "
            "UNION ALL SELECT symbol, 'DataQualityError', 'warning', 'continue' FROM quality WHERE NOT stasis_ok) GROUP BY ALL",
            "dirty",
            **_quality_of("dirty"),
        ),
        keys=("error_type", "severity", "action", "events", "affected_symbols"),
    ),
}
