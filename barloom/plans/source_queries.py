"""Registered queries: sources, registry, alignment and cross-asset features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import align, cross_asset
from barloom.operators import features as ft
from barloom.plans.entries import Entry, entry, same
from barloom.plans.oracle import W, roll, roll_corr, sql
from barloom.sources import bars as src
from barloom.sources import registry as reg
from barloom.sources import sinks

START, END = "1996-02-01", "2000-06-30"
MIN_DAYS = 1300


def _scan(spark, sf):
    """Line items as vendor rows: other names, a timestamp, a range with both ends."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    vendor = {
        "l_suppkey": "symbol",
        "l_shipdate": "date",
        "l_extendedprice": "open",
        "l_discount": "high",
        "l_tax": "low",
        "l_linenumber": "close",
        "l_quantity": "volume",
    }
    return src.scan_bars(line, start_date=START, end_date=END, rename=vendor)


def _primary(spark, sf):
    """Two vendors: the first is disordered for every fifth brand, the second lacks brands 1 to 12."""
    high = F.when((src.brand_no() % 5 == 0) & (F.dayofyear("date") == 50), F.col("low") - 1).otherwise(F.col("high"))
    return src.bars(spark, sf).withColumn("high", high)


def _fallback(spark, sf):
    return src.bars(spark, sf).where(src.brand_no() > 12)


_NO = "CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS BIGINT)"
_VENDORS = {
    "prim": f"SELECT symbol, date, open, CASE WHEN {_NO} % 5 = 0 AND dayofyear(date) = 50 THEN low - 1 ELSE high END AS high, low, close, volume FROM bars",
    "fall": f"SELECT * FROM bars WHERE {_NO} > 12",
    "vp": "SELECT symbol, count(*) AS n, count(*) FILTER (WHERE high < low OR high < close OR low > close) AS bad FROM prim GROUP BY symbol",
    "vf": "SELECT symbol, count(*) AS n, count(*) FILTER (WHERE high < low OR high < close OR low > close) AS bad FROM fall GROUP BY symbol",
    "choice": f"SELECT symbol, CASE WHEN vp.bad = 0 AND vp.n >= {MIN_DAYS} THEN 'primary' WHEN vf.bad = 0 AND vf.n >= {MIN_DAYS} THEN 'fallback' ELSE 'failed' END AS source FROM vp FULL JOIN vf USING (symbol)",
}


def _market_raw(spark, sf):
    """Market rows with repeated days, text closes and bad values, in ingest order."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    close = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(
        F.when(F.col("l_linenumber") == 6, "-1.5").otherwise(F.floor(F.col("l_extendedprice") / 16).cast("string"))
    )
    return line.select(
        F.concat(F.lit("t"), (F.col("l_suppkey") % 5).cast("string")).alias("ticker"),
        F.col("l_shipdate").alias("date"),
        close.alias("close"),
        (
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 65536 + F.floor(F.col("l_extendedprice") / 16)
        ).alias("ingest_seq"),
    )


_MARKET_NORM = """SELECT upper('t' || (l_suppkey % 5)) AS ticker, CAST(l_shipdate AS DATE) AS date,
  arg_max(CASE l_linenumber WHEN 7 THEN -1 WHEN 6 THEN -1.5 ELSE floor(l_extendedprice / 16) END,
          (l_orderkey * 8 + l_linenumber) * 65536 + CAST(floor(l_extendedprice / 16) AS BIGINT)) AS close
  FROM lineitem GROUP BY ALL"""


def _cached_market(spark, sf):
    path = sinks.scratch_path(spark, "market-cache")
    src.write_market_cache(src.market(spark, sf), path, version="v1")
    return src.read_market_cache(spark, path, version="v1", symbols=["spy", "XLE"], start_date=START, end_date=END)


def _registry_file(spark, sf):
    path = sinks.scratch_path(spark, "registry")
    reg.save_registry(src.registry(spark, sf), path)
    return reg.load_registry(spark, path)


def _upserted(spark, sf):
    """Suppliers become new registry rows; one exchange in four is unknown; brands are repeated in lower case."""
    base = src.registry(spark, sf)
    exchanges = F.array(F.lit("nyse"), F.lit("Nasdaq"), F.lit("LSE"), F.lit("AMEX"))
    new = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")))
        .otherwise(F.concat(F.lit("sup"), F.col("s_suppkey").cast("string")))
        .alias("symbol"),
        F.col("s_name").alias("company_name"),
        F.lit("Utilities").alias("sector"),
        F.element_at(exchanges, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("exchange"),
        F.lit(None).cast("date").alias("first_trade_date"),
        F.lit(None).cast("date").alias("last_trade_date"),
        F.lit("active").alias("status"),
    )
    return reg.upsert_symbols(base.withColumn("symbol", F.upper("symbol")), new)


_UPSERT = {
    "ups": """SELECT upper(symbol) AS symbol, company_name, sector, exchange, status, 0 AS seq FROM registry
      UNION ALL SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'BRAND#' || (s_suppkey % 25 + 1) ELSE 'SUP' || s_suppkey END, s_name, 'Utilities',
      CASE s_suppkey % 4 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ' ELSE 'AMEX' END, 'ACTIVE', 1 FROM supplier WHERE s_suppkey % 4 <> 2"""
}


def _asked(spark, sf):
    """Symbols to look up: the brands of all parts, in lower case, and one unknown per manufacturer type."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select(F.lower("p_brand").alias("symbol")).union(part.select("p_type")).distinct()


_ASKED = {"asked": "SELECT lower(p_brand) AS symbol FROM part UNION SELECT p_type FROM part"}


def _leaders(spark, sf):
    """One target per sector: its first symbol."""
    return src.registry(spark, sf).groupBy("sector").agg(F.min("symbol").alias("symbol")).select("symbol")


def _indices(spark, sf):
    return src.market(spark, sf).select("ticker").distinct().where("ticker <> 'SPY'")


_PAIRS = {
    "leaders": "SELECT sector, min(symbol) AS symbol FROM registry GROUP BY sector",
    "pairs": "SELECT upper(l.symbol) AS symbol, upper(r.symbol) AS peer FROM leaders l JOIN registry r ON r.sector = l.sector AND r.symbol <> l.symbol",
}
_ALIGNED = f"""SELECT b.symbol, b.date, b.close, last_value(s.close IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.date) AS spy_close,
  last_value(e.close IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.date) AS etf_close
  FROM (SELECT * FROM bars JOIN (SELECT DISTINCT symbol, etf FROM sectors) USING (symbol)) b
  LEFT JOIN market s ON s.ticker = 'SPY' AND s.date = b.date LEFT JOIN market e ON e.ticker = b.etf AND e.date = b.date"""
_CROSS = {
    "al": _ALIGNED,
    "rets": f"""SELECT *, close / lag(close) OVER ({W}) - 1 AS ret, spy_close / lag(spy_close) OVER ({W}) - 1 AS sret, etf_close / lag(etf_close) OVER ({W}) - 1 AS eret,
      spy_close / lag(spy_close, 60) OVER ({W}) - 1 AS trend FROM al""",
    "x": f"""SELECT *, {roll_corr('ret', 'sret', 60)} AS relative_strength, {roll_corr('ret', 'eret', 60)} AS sector_correlation,
      {roll('stddev_samp', 'sret', 60)} * sqrt(252) AS market_volatility_annualized FROM rets""",
}
VOL = 1.9


def _sparse_market(spark, sf):
    """Market rows of every third day only, so that as-of and exact alignment differ."""
    return src.market(spark, sf).where(F.unix_date("date") % 3 == 0)


def _cross(spark, sf):
    return cross_asset.market_features(
        src.bars(spark, sf), src.market(spark, sf), src.registry(spark, sf), high_volatility_threshold=VOL
    )


_PEER_BY = "PARTITION BY symbol, peer ORDER BY date"
_PEER = {
    "pr": """SELECT b.symbol, b.date, b.close, q.peer, last_value(m.close IGNORE NULLS) OVER (PARTITION BY b.symbol, q.peer ORDER BY b.date) AS pc
      FROM bars b JOIN pairs q ON upper(q.symbol) = upper(b.symbol) LEFT JOIN bars m ON upper(m.symbol) = upper(q.peer) AND m.date = b.date""",
    "pret": f"SELECT *, close / lag(close) OVER ({_PEER_BY}) - 1 AS r, pc / lag(pc) OVER ({_PEER_BY}) - 1 AS p FROM pr",
    "pcorr": f"SELECT symbol, peer, date, {roll_corr('r', 'p', 60, _PEER_BY)} AS correlation FROM pret",
}
_ALL_PAIRS = {"pairs": "SELECT l.symbol, r.symbol AS peer FROM registry l JOIN registry r ON r.sector = l.sector AND r.symbol <> l.symbol"}
_RANKED = {**_ALL_PAIRS, **_PEER, "ranked": "SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY correlation DESC, peer) AS k FROM pcorr WHERE correlation IS NOT NULL"}


def _intraday_asof(spark, sf):
    """Last view price known at each purchase, per user bucket."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select(
        F.lit("all").alias("book"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))).alias("date"),
        "event_id",
        "event_type",
        "value",
    )
    left = ev.where("event_type = 'purchase'").select("book", "date", "event_id")
    right = ev.where("event_type = 'view'").select("book", "date", F.col("value").alias("view_value"))
    return align.asof_join(left, right, by="book", value_cols=["view_value"], rows_per_slice=4096)


ENTRIES: dict[str, Entry] = {
    "scan_bars": entry(
        _scan,
        f"SELECT l_suppkey::VARCHAR AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS open, l_discount AS high, l_tax AS low, l_linenumber AS close, l_quantity AS volume "
        f"FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'",
        keys=("date",),
        digits=same("symbol open high low close volume", 6),
    ),
    "source_validate": entry(
        lambda spark, sf: src.source_validate(src.bars_dirty(spark, sf)),
        sql(
            'SELECT symbol, count(*) AS "rows", count(*) FILTER (WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS null_rows, '
            "count(*) FILTER (WHERE high < low OR high < close OR low > close) AS bad_rows, "
            "bool_and(coalesce(NOT (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AND NOT (high < low OR high < close OR low > close), false)) AS valid FROM dirty GROUP BY symbol",
            "dirty",
        ),
        keys=("symbol", "rows", "null_rows", "bad_rows", "valid"),
    ),
    "source_fallback": entry(
        lambda spark, sf: src.source_fallback(_primary(spark, sf), _fallback(spark, sf), min_trading_days=MIN_DAYS),
        sql(
            "SELECT symbol, date, source, close FROM (SELECT *, 'primary' AS source FROM prim UNION ALL SELECT *, 'fallback' FROM fall) JOIN choice USING (symbol, source)",
            "bars",
            **_VENDORS,
        ),
        keys=("symbol", "date", "source"),
        digits={"close": 8},
    ),
    "acquisition_summary": entry(
        lambda spark, sf: src.acquisition_summary(
            src.source_choice(_primary(spark, sf), _fallback(spark, sf), min_trading_days=MIN_DAYS)
        ),
        sql(
            "SELECT count(*) AS attempts, count(*) FILTER (WHERE source <> 'failed') AS successes, count(*) FILTER (WHERE source = 'failed') AS failures, count(*) FILTER (WHERE source = 'primary') AS from_primary, "
            "count(*) FILTER (WHERE source = 'fallback') AS from_fallback, count(*) FILTER (WHERE source <> 'failed') / count(*) AS success_rate FROM choice",
            "bars",
            **_VENDORS,
        ),
        keys=("attempts", "successes", "failures", "from_primary", "from_fallback"),
        digits={"success_rate": 8},
    ),
    "market_normalise": entry(
        lambda spark, sf: src.market_normalise(_market_raw(spark, sf)),
        sql("SELECT * FROM m WHERE close > 0", m=_MARKET_NORM),
        keys=("ticker", "date"),
        digits={"close": 6},
    ),
    "market_cache": entry(
        _cached_market,
        sql(f"SELECT * FROM market WHERE ticker IN ('SPY', 'XLE') AND date BETWEEN DATE '{START}' AND DATE '{END}'", "market"),
        keys=("ticker", "date"),
        digits={"close": 8},
    ),
    "registry_load": entry(
        _registry_file,
        sql("SELECT upper(symbol) AS symbol, company_name, sector, exchange, first_trade_date, last_trade_date, status FROM registry", "registry"),
        keys=reg.COLUMNS,
    ),
    "registry_save": entry(
        lambda spark, sf: reg.registry_info(_registry_file(spark, sf)).select("total_symbols", "active_symbols"),
        sql("SELECT count(*) AS total_symbols, count(*) FILTER (WHERE status = 'ACTIVE') AS active_symbols FROM registry", "registry"),
        keys=("total_symbols", "active_symbols"),
    ),
    "registry_upsert": entry(
        _upserted,
        sql("SELECT * FROM ups", "registry", **_UPSERT),
        keys=("symbol", "company_name", "sector", "exchange", "status"),
    ),
    "registry_info": entry(
        lambda spark, sf: reg.registry_info(_upserted(spark, sf)).withColumns(
            {"sectors": F.array_join("sectors", ","), "exchanges": F.array_join("exchanges", ",")}
        ),
        sql(
            "SELECT count(*) AS total_symbols, count(*) FILTER (WHERE status = 'ACTIVE') AS active_symbols, string_agg(DISTINCT sector, ',' ORDER BY sector) AS sectors, "
            "string_agg(DISTINCT exchange, ',' ORDER BY exchange) AS exchanges FROM ups",
            "registry",
            **_UPSERT,
        ),
        keys=("total_symbols", "active_symbols", "sectors", "exchanges"),
    ),
    "symbol_active": entry(
        lambda spark, sf: reg.symbol_active(_asked(spark, sf), src.registry(spark, sf)),
        sql("SELECT a.symbol, coalesce(r.status = 'ACTIVE', false) AS active FROM asked a LEFT JOIN registry r ON upper(r.symbol) = upper(a.symbol)", "registry", **_ASKED),
        keys=("symbol", "active"),
    ),
    "sector_lookup": entry(
        lambda spark, sf: reg.lookup(_asked(spark, sf), src.registry(spark, sf), "sector"),
        sql("SELECT a.symbol, r.sector FROM asked a LEFT JOIN registry r ON upper(r.symbol) = upper(a.symbol)", "registry", **_ASKED),
        keys=("symbol", "sector"),
    ),
    "exchange_lookup": entry(
        lambda spark, sf: reg.lookup(_asked(spark, sf), src.registry(spark, sf), "exchange"),
        sql("SELECT a.symbol, r.exchange FROM asked a LEFT JOIN registry r ON upper(r.symbol) = upper(a.symbol)", "registry", **_ASKED),
        keys=("symbol", "exchange"),
    ),
    "symbols_by_sector": entry(
        lambda spark, sf: reg.symbols_by_sector(src.registry(spark, sf), "ENERGY"),
        sql("SELECT symbol FROM registry WHERE lower(sector) = 'energy'", "registry"),
        keys=("symbol",),
    ),
    "active_symbols": entry(
        lambda spark, sf: reg.active_symbols(src.registry(spark, sf)),
        sql("SELECT symbol FROM registry WHERE status = 'ACTIVE'", "registry"),
        keys=("symbol",),
    ),
    "sector_etf_map": entry(
        lambda spark, sf: src.registry(spark, sf).select("symbol", "sector", src.sector_etf(F.col("sector")).alias("etf")),
        sql("SELECT DISTINCT symbol, sector, etf FROM sectors", "sectors"),
        keys=("symbol", "sector", "etf"),
    ),
    "align_exact_ffill": entry(
        lambda spark, sf: align.align_exact_ffill(src.bars(spark, sf), _sparse_market(spark, sf), {"market_close": "SPY"}),
        sql(
            "SELECT b.symbol, b.date, last_value(m.close IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.date) AS market_close FROM bars b LEFT JOIN "
            "(SELECT * FROM market WHERE (date - DATE '1970-01-01') % 3 = 0) m ON m.ticker = 'SPY' AND m.date = b.date",
            "bars",
            "market",
        ),
        digits={"market_close": 8},
    ),
    "align_asof": entry(
        lambda spark, sf: align.align_asof(src.bars(spark, sf), _sparse_market(spark, sf), "SPY"),
        sql(
            "SELECT b.symbol, b.date, m.close AS market_close FROM bars b ASOF LEFT JOIN (SELECT date, close FROM market WHERE ticker = 'SPY' AND (date - DATE '1970-01-01') % 3 = 0) m ON b.date >= m.date",
            "bars",
            "market",
        ),
        digits={"market_close": 8},
    ),
    "align_asof_intraday": entry(
        _intraday_asof,
        "SELECT l.event_id, r.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.ts >= r.ts",
        keys=("event_id",),
        digits={"view_value": 6},
    ),
    "feature_join": entry(
        lambda spark, sf: align.join_features(
            ft.compute_features(src.bars(spark, sf), [ft.returns()]).select("symbol", "date", "simple_return"),
            _cross(spark, sf).select("symbol", "date", "relative_strength"),
        ),
        sql("SELECT symbol, date, ret AS simple_return, relative_strength FROM x", "bars", "market", **_CROSS),
        digits={"simple_return": 8, "relative_strength": 6},
    ),
    "relative_strength": entry(
        lambda spark, sf: cross_asset.relative_strength(src.bars(spark, sf), src.market(spark, sf)),
        sql(
            f"SELECT symbol, date, {roll_corr('ret', 'mret', 60)} AS relative_strength FROM r",
            "bars",
            "market",
            a="SELECT b.*, m.close AS mc FROM bars b ASOF LEFT JOIN (SELECT date, close FROM market WHERE ticker = 'SPY') m ON b.date >= m.date",
            r=f"SELECT *, close / lag(close) OVER ({W}) - 1 AS ret, mc / lag(mc) OVER ({W}) - 1 AS mret FROM a",
        ),
        digits={"relative_strength": 6},
    ),
    "sector_correlation": entry(
        _cross,
        sql("SELECT symbol, date, sector_correlation FROM x", "bars", "market", **_CROSS),
        digits={"sector_correlation": 6},
    ),
    "market_regime_spy": entry(
        _cross,
        sql(
            f"SELECT symbol, date, market_volatility_annualized, CASE WHEN trend IS NULL OR market_volatility_annualized IS NULL THEN NULL WHEN market_volatility_annualized > {VOL} THEN 3 "
            "WHEN trend > 0.02 THEN 2 WHEN trend < -0.02 THEN 0 ELSE 1 END AS spy_market_regime FROM x",
            "bars",
            "market",
            **_CROSS,
        ),
        digits={"spy_market_regime": 0, "market_volatility_annualized": 6},
    ),
    "peer_pairs": entry(
        lambda spark, sf: cross_asset.peers_of(_leaders(spark, sf), src.registry(spark, sf), _indices(spark, sf)),
        sql(
            "SELECT * FROM pairs UNION SELECT upper(l.symbol), m.ticker FROM leaders l, (SELECT DISTINCT ticker FROM market WHERE ticker <> 'SPY') m",
            "registry",
            "market",
            **_PAIRS,
        ),
        keys=("symbol", "peer"),
    ),
    "peer_corr": entry(
        lambda spark, sf: cross_asset.peer_correlations(
            src.bars(spark, sf).withColumn("symbol", F.upper("symbol")),
            cross_asset.peers_of(_leaders(spark, sf), src.registry(spark, sf)),
        ),
        sql("SELECT upper(symbol) AS symbol, peer, date, correlation FROM pcorr", "bars", "registry", **_PAIRS, **_PEER),
        keys=("symbol", "peer", "date"),
        digits={"correlation": 6},
    ),
    "peer_topk": entry(
        lambda spark, sf: cross_asset.peer_topk(src.bars(spark, sf), src.registry(spark, sf)),
        sql(
            "SELECT b.symbol, b.date, "
            + ", ".join(f"max(correlation) FILTER (WHERE k = {k}) AS sector_peer_corr_top_{k}" for k in range(1, 6))
            + ", avg(correlation) FILTER (WHERE k <= 5) AS sector_peer_corr_top_mean FROM bars b LEFT JOIN ranked r ON b.symbol = r.symbol AND b.date = r.date GROUP BY b.symbol, b.date",
            "bars",
            "registry",
            **_RANKED,
        ),
        digits=same([*(f"sector_peer_corr_top_{k}" for k in range(1, 6)), "sector_peer_corr_top_mean"]),
    ),
    "latest_top_peers": entry(
        lambda spark, sf: cross_asset.latest_top_peers(src.bars(spark, sf), src.registry(spark, sf)),
        sql(
            "SELECT symbol, date, k AS rank, peer, correlation FROM ranked WHERE k <= 5 AND (symbol, date) IN (SELECT (symbol, max(date)) FROM bars GROUP BY symbol)",
            "bars",
            "registry",
            **_RANKED,
        ),
        keys=("symbol", "date", "rank", "peer"),
        digits={"correlation": 6},
    ),
}
