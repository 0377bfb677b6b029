"""SQL building blocks for the reference answers that the checks run in DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from barloom.sources.bars import SECTOR_ETFS

W = "PARTITION BY symbol ORDER BY date"


def roll(fn: str, col: str, n: int, by: str = W) -> str:
    frame = f"OVER ({by} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({col}) {frame} = {n} THEN {fn}({col}) {frame} END"


def roll_corr(x: str, y: str, n: int, by: str = W) -> str:
    frame = f"OVER ({by} ROWS {n - 1} PRECEDING)"
    px = f"CASE WHEN {y} IS NOT NULL THEN {x} END"
    py = f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return (
        f"CASE WHEN count({px}) {frame} = {n} THEN covar_samp({px}, {py}) {frame} / "
        f"NULLIF(stddev_samp({px}) {frame} * stddev_samp({py}) {frame}, 0) END"
    )


def ewm(source: str, col: str, span: float, keys: str = "symbol") -> str:
    """Query giving (symbol, date, y): the recursive mean written out as a weighted sum."""
    a = 2.0 / (span + 1.0)
    return f"""
      SELECT t.symbol, t.date, sum(CASE WHEN s.n = 1 THEN 1e0 ELSE {a!r}::DOUBLE END
             * pow({1 - a!r}::DOUBLE, (t.n - s.n)::DOUBLE) * s.x) AS y
      FROM (SELECT symbol, date, {col} AS x, row_number() OVER ({W}) AS n FROM {source} WHERE {col} IS NOT NULL) t
      JOIN (SELECT symbol, {col} AS x, row_number() OVER ({W}) AS n FROM {source} WHERE {col} IS NOT NULL) s
        ON t.symbol = s.symbol AND s.n <= t.n
      GROUP BY t.symbol, t.date"""


_SECTORS = list(SECTOR_ETFS)[:5]
_SECTOR_CASE = "CASE no % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SECTORS)) + " END"
_ETF_CASE = "CASE sector " + " ".join(f"WHEN '{s}' THEN '{SECTOR_ETFS[s]}'" for s in _SECTORS) + " END"
_OHLCV = """300e0 + (first_key % 65536) / 64e0 AS open, 300e0 + top / 64e0 AS high,
       300e0 + bottom / 64e0 AS low, 300e0 + (last_key % 65536) / 64e0 AS close, volume"""
_MERGE = """min(first_key) AS first_key, max(last_key) AS last_key, max(top) AS top, min(bottom) AS bottom,
       sum(volume) AS volume"""

CTES: dict[str, tuple[Sequence[str], str]] = {
    "lines": (
        (),
        """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_quantity AS volume,
       CAST(floor(l_extendedprice / 16) AS BIGINT) AS tick,
       (l_orderkey * 8 + l_linenumber) * 65536 + CAST(floor(l_extendedprice / 16) AS BIGINT) AS k
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "trades": (
        ("lines",),
        """SELECT symbol, date, min(k) AS first_key, max(k) AS last_key, max(tick) AS top, min(tick) AS bottom,
       sum(volume) AS volume, CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS BIGINT) AS no
       FROM lines GROUP BY symbol, date""",
    ),
    "bars": (("trades",), f"SELECT symbol, date, {_OHLCV} FROM trades"),
    "base": (
        ("bars",),
        f"""SELECT *, lag(close) OVER ({W}) AS prev, close / lag(close) OVER ({W}) - 1 AS ret FROM bars""",
    ),
    "sectors": (
        ("trades",),
        f"SELECT *, {_ETF_CASE} AS etf FROM (SELECT *, {_SECTOR_CASE} AS sector FROM trades)",
    ),
    "market": (
        ("sectors",),
        f"""SELECT ticker, date, {_OHLCV} FROM (
         SELECT 'SPY' AS ticker, date, {_MERGE} FROM sectors GROUP BY date
         UNION ALL SELECT etf, date, {_MERGE} FROM sectors GROUP BY etf, date)""",
    ),
    "registry": (
        ("sectors",),
        """SELECT symbol, 'Company ' || any_value(no) AS company_name, any_value(sector) AS sector,
       CASE any_value(no) % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ' ELSE 'AMEX' END AS exchange,
       min(date) AS first_trade_date, max(date) AS last_trade_date,
       CASE WHEN any_value(no) % 7 = 0 THEN 'DELISTED' ELSE 'ACTIVE' END AS status
       FROM sectors GROUP BY symbol""",
    ),
    "numbered": (
        ("bars",),
        """SELECT *, date - DATE '1970-01-01' AS dd, CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS BIGINT) AS no
       FROM bars""",
    ),
    "dirty": (
        ("numbered",),
        """SELECT symbol, date,
       CASE WHEN (dd + no) % 41 = 0 THEN NULL WHEN (dd + no) % 101 = 2 THEN 0e0 ELSE open END AS open,
       CASE WHEN (dd + 2 * no) % 47 = 0 THEN NULL WHEN (dd + 5 * no) % 37 = 0 THEN low ELSE high END AS high,
       CASE WHEN ((dd + no) // 5) % 53 = 0 THEN NULL WHEN (dd + 5 * no) % 37 = 0 THEN high
            WHEN (dd + no) % 103 = 3 THEN -low ELSE low END AS low,
       CASE WHEN ((dd + 3 * no) // 4) % 61 = 0 THEN NULL WHEN (dd + no) % 59 = 0 THEN close * 1.5e0
            WHEN (dd + no) % 59 = 1 THEN close * 0.5e0 ELSE close END AS close,
       CASE WHEN (dd + no) % 97 = 0 THEN NULL WHEN (dd + no) % 89 = 1 THEN 0e0 ELSE volume END AS volume
       FROM numbered""",
    ),
    "brand_days": (
        (),
        """SELECT symbol, CAST(d AS DATE) AS day, CAST(d AS DATE) - DATE '1970-01-01' AS dd,
       CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS BIGINT) AS no
       FROM (SELECT DISTINCT p_brand AS symbol FROM part), range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY) t(d)""",
    ),
    "actions": (
        ("brand_days",),
        """SELECT symbol, day AS date, 'split' AS type, 2e0 AS factor, NULL::DOUBLE AS amount
       FROM brand_days WHERE (dd + no) % 331 = 0
       UNION ALL SELECT symbol, day + CAST(no % 2 AS INTEGER), 'dividend', NULL, 1 + no / 8e0
       FROM brand_days WHERE (dd + 7 * no) % 211 = 0""",
    ),
    "ticks": (
        (),
        """SELECT event_type AS symbol, ts AS date, value + 1 AS close, CAST(event_id % 100 + 1 AS DOUBLE) AS volume
       FROM events""",
    ),
}


def sql(body: str, *needs: str, **extra: str) -> str:
    """``body`` behind the named building blocks and any extra ones, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in ordered] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
