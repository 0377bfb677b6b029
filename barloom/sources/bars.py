"""Bar sources: reading, normalising, accepting, falling back, and market series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.guards import broadcast_if_small

PRICES = ("open", "high", "low", "close")
OHLCV = (*PRICES, "volume")

# Sector names and the exchange-traded fund that stands for each.
SECTOR_ETFS = {
    "Communication Services": "XLC",
    "Consumer Discretionary": "XLY",
    "Consumer Staples": "XLP",
    "Energy": "XLE",
    "Financials": "XLF",
    "Health Care": "XLV",
    "Industrials": "XLI",
    "Information Technology": "XLK",
    "Materials": "XLB",
    "Real Estate": "XLRE",
    "Utilities": "XLU",
}
# The older upper-case sector names.
LEGACY_SECTOR_ETFS = {
    "TECH": "XLK",
    "HEALTHCARE": "XLV",
    "FINANCIAL": "XLF",
    "ENERGY": "XLE",
    "INDUSTRIAL": "XLI",
    "CONSUMER": "XLY",
    "STAPLES": "XLP",
    "REALESTATE": "XLRE",
    "UTILITY": "XLU",
    "MATERIALS": "XLB",
}
BENCHMARK = "SPY"


def read_bars(spark: SparkSession, path: str, *, fmt: str = "parquet", **options: str) -> DataFrame:
    """Read a bar table (parquet, orc, csv or json); csv gets a header and explicit types."""
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("csv", "json"):
        reader = reader.option("header", True).schema(
            "symbol STRING, date STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
        )
    return reader.load(path)


def scan_bars(
    df: DataFrame,
    *,
    start_date: str | Date | None = None,
    end_date: str | Date | None = None,
    rename: Mapping[str, str] | None = None,
    symbol_col: str = "symbol",
) -> DataFrame:
    """Normalise vendor columns to (symbol, date, ohlcv) and keep ``start <= date <= end``.

    The range test stays on the source date column, so it reaches the file scan.
    """
    source = {v: k for k, v in (rename or {}).items()}
    raw_date = source.get("date", "date")
    if start_date is not None:
        df = df.where(F.col(raw_date) >= F.lit(str(start_date)).cast("timestamp"))
    if end_date is not None:
        df = df.where(F.col(raw_date) < F.date_add(F.lit(str(end_date)).cast("date"), 1).cast("timestamp"))
    return df.select(
        F.col(source.get("symbol", symbol_col)).alias("symbol"),
        F.to_date(raw_date).alias("date"),
        *[F.col(source.get(c, c)).cast("double").alias(c) for c in OHLCV],
    )


def normalize_bars(df: DataFrame, *, order_col: str | None = None) -> DataFrame:
    """One row per (symbol, date), NaN as NULL; the row with the largest ``order_col`` wins.

    This is the guarantee that bounds every per-symbol window group.
    """
    last = F.col(order_col) if order_col else F.struct(*OHLCV)
    row = F.max_by(F.struct(*OHLCV), last).alias("_row")
    one = df.groupBy("symbol", F.to_date("date").alias("date")).agg(row).select("symbol", "date", "_row.*")
    return one.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in OHLCV})


def bad_source_order() -> Column:
    """A bar that no source may contain (the open is not checked here)."""
    return (F.col("high") < F.col("low")) | (F.col("high") < F.col("close")) | (F.col("low") > F.col("close"))


def source_validate(df: DataFrame) -> DataFrame:
    """Acceptance per symbol: rows, null rows, disordered rows and the verdict."""
    missing = [c for c in OHLCV if c not in df.columns]
    if missing:
        raise ValueError(f"missing bar columns: {missing}")
    any_null = F.lit(False)
    for c in OHLCV:
        any_null = any_null | F.col(c).isNull()
    return (
        df.groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(any_null).alias("null_rows"),
            F.count_if(bad_source_order()).alias("bad_rows"),
        )
        .withColumn("valid", (F.col("null_rows") == 0) & (F.col("bad_rows") == 0))
    )


def source_choice(primary: DataFrame, fallback: DataFrame, *, min_trading_days: int = 2500) -> DataFrame:
    """Per symbol: the source used, or 'failed' when neither has enough valid rows."""

    def usable(df: DataFrame, name: str) -> DataFrame:
        ok = F.col("valid") & (F.col("rows") >= min_trading_days)
        return source_validate(df).select("symbol", ok.alias(name))

    return (
        usable(primary, "p")
        .join(usable(fallback, "f"), "symbol", "full_outer")
        .select(
            "symbol",
            F.when(F.col("p"), "primary").when(F.col("f"), "fallback").otherwise("failed").alias("source"),
        )
    )


def source_fallback(primary: DataFrame, fallback: DataFrame, *, min_trading_days: int = 2500) -> DataFrame:
    """Bars of the chosen source per symbol, with the source name."""
    choice = source_choice(primary, fallback, min_trading_days=min_trading_days)
    tagged = primary.withColumn("source", F.lit("primary")).unionByName(
        fallback.withColumn("source", F.lit("fallback"))
    )
    return tagged.join(broadcast_if_small(choice.where("source <> 'failed'")), ["symbol", "source"])


def acquisition_summary(choice: DataFrame) -> DataFrame:
    """Attempts, successes, failures, success rate and the count per source."""
    used = lambda name: F.count_if(F.col("source") == name)
    return choice.agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("source") != "failed").alias("successes"),
        used("failed").alias("failures"),
        used("primary").alias("from_primary"),
        used("fallback").alias("from_fallback"),
        F.try_divide(F.count_if(F.col("source") != "failed"), F.count(F.lit(1))).alias("success_rate"),
    )


def market_normalise(df: DataFrame, *, close_col: str = "close", seq_col: str = "ingest_seq") -> DataFrame:
    """Market series: numeric positive closes, the last ingested row per (ticker, date)."""
    typed = df.select(
        F.upper("ticker").alias("ticker"),
        F.to_date("date").alias("date"),
        F.expr(f"try_cast({close_col} AS DOUBLE)").alias("close"),
        F.col(seq_col).alias("_seq"),
    )
    last = typed.groupBy("ticker", "date").agg(F.max_by("close", "_seq").alias("close"))
    return last.where((F.col("close") > 0) & ~F.isnan("close"))


def write_market_cache(df: DataFrame, path: str, *, version: str) -> None:
    """Versioned market extract, one folder per (version, ticker); a refresh replaces only its folders."""
    (
        df.withColumn("cache_version", F.lit(version))
        .repartition("ticker", F.year("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("cache_version", "ticker")
        .parquet(path)
    )


def read_market_cache(
    spark: SparkSession,
    path: str,
    *,
    version: str,
    symbols: Sequence[str] | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
) -> DataFrame:
    """Cached rows, end date included; version and ticker prune folders."""
    df = spark.read.parquet(path).where(F.col("cache_version") == version)
    if symbols is not None:
        df = df.where(F.col("ticker").isin([s.upper() for s in symbols]))
    if start_date is not None:
        df = df.where(F.col("date") >= F.lit(start_date).cast("date"))
    if end_date is not None:
        df = df.where(F.col("date") <= F.lit(end_date).cast("date"))
    return df.select("ticker", "date", "close")


def sector_etf(sector: Column, *, legacy: bool = False) -> Column:
    """Fund of a sector, NULL when the sector is unknown."""
    table = LEGACY_SECTOR_ETFS if legacy else SECTOR_ETFS
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), sector)


# Tables of this repository's test data, seen as bars.

TICK = 64
TICK_BASE = 300


def trade_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per part brand from the line items.

    A line is a trade: its price is a whole number of 1/64 ticks, its order in the
    day is (order, line, tick). Order and tick share one BIGINT, so first and last
    trade are plain min and max: fixed-width buffers, hashed map-side before the
    shuffle, at most one row per (brand, day) and task after it.
    """
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_partkey",
        F.to_date("l_shipdate").alias("date"),
        F.floor(F.col("l_extendedprice") / 16).alias("tick"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_quantity").alias("volume"),
    )
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("symbol"))
    key = F.col("seq") * 65536 + F.col("tick")
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .groupBy("symbol", "date")
        .agg(
            F.min(key).alias("first_key"),
            F.max(key).alias("last_key"),
            F.max("tick").alias("top"),
            F.min("tick").alias("bottom"),
            F.sum("volume").alias("volume"),
        )
    )


def trade_price(tick: Column) -> Column:
    return F.lit(float(TICK_BASE)) + tick / F.lit(float(TICK))


def as_ohlcv(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys,
        trade_price(F.col("first_key") % 65536).alias("open"),
        trade_price(F.col("top")).alias("high"),
        trade_price(F.col("bottom")).alias("low"),
        trade_price(F.col("last_key") % 65536).alias("close"),
        "volume",
    )


def roll_up(trades: DataFrame, *keys: str) -> DataFrame:
    """Merge trade aggregates to coarser keys (all brands, or a sector)."""
    return trades.groupBy(*keys).agg(
        F.min("first_key").alias("first_key"),
        F.max("last_key").alias("last_key"),
        F.max("top").alias("top"),
        F.min("bottom").alias("bottom"),
        F.sum("volume").alias("volume"),
    )


def brand_no(symbol: Column | str = "symbol") -> Column:
    return F.regexp_extract(symbol, r"(\d+)$", 1).cast("int")


def brand_sector(symbol: Column | str = "symbol") -> Column:
    names = list(SECTOR_ETFS)[:5]
    return F.element_at(F.array(*[F.lit(n) for n in names]), brand_no(symbol) % 5 + 1)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ohlcv(trade_bars(spark, sf_dir), "symbol", "date")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark and sector series (ticker, date, close) from the same trades."""
    trades = trade_bars(spark, sf_dir)
    etf = sector_etf(brand_sector()).alias("ticker")
    both = trades.withColumn("ticker", F.explode(F.array(F.lit(BENCHMARK), etf)))
    return as_ohlcv(roll_up(both, "ticker", "date"), "ticker", "date").select("ticker", "date", "close")


def day_no(col: str = "date") -> Column:
    return F.unix_date(col)


def bars_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bars`` with nulls, zeros, negatives, swaps and jumps set by arithmetic on day and brand number."""
    dd, no = day_no(), brand_no()
    hit = lambda value, mod, at=0: value % mod == at
    df = bars(spark, sf_dir).select(
        "symbol",
        "date",
        F.when(hit(dd + no, 41), None).when(hit(dd + no, 101, 2), 0.0).otherwise(F.col("open")).alias("open"),
        F.when(hit(dd + 2 * no, 47), None)
        .when(hit(dd + 5 * no, 37), F.col("low"))
        .otherwise(F.col("high"))
        .alias("high"),
        F.when(hit(F.floor((dd + no) / 5), 53), None)
        .when(hit(dd + 5 * no, 37), F.col("high"))
        .when(hit(dd + no, 103, 3), -F.col("low"))
        .otherwise(F.col("low"))
        .alias("low"),
        F.when(hit(F.floor((dd + 3 * no) / 4), 61), None)
        .when(hit(dd + no, 59), F.col("close") * 1.5)
        .when(hit(dd + no, 59, 1), F.col("close") * 0.5)
        .otherwise(F.col("close"))
        .alias("close"),
        F.when(hit(dd + no, 97), None).when(hit(dd + no, 89, 1), 0.0).otherwise(F.col("volume")).alias("volume"),
    )
    return df


def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits and dividends per part brand on days set by arithmetic; many fall beside a bar date."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("symbol")).distinct()
    days = F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date"))
    base = part.select("symbol", F.explode(days).alias("day"), brand_no().alias("no")).withColumn("dd", day_no("day"))

    def action(hit: Column, date: Column, kind: str, factor: Column, amount: Column) -> Column:
        row = F.struct(
            date.alias("date"),
            F.lit(kind).alias("type"),
            factor.cast("double").alias("factor"),
            amount.cast("double").alias("amount"),
        )
        return F.when(hit, row)

    split = action((F.col("dd") + F.col("no")) % 331 == 0, F.col("day"), "split", F.lit(2.0), F.lit(None))
    dividend = action(
        (F.col("dd") + 7 * F.col("no")) % 211 == 0,
        F.date_add("day", F.col("no") % 2),
        "dividend",
        F.lit(None),
        1 + F.col("no") / F.lit(8.0),
    )
    return base.select("symbol", F.inline(F.array_compact(F.array(split, dividend))))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday series: every event is one bar of its event type, in microsecond order."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value")
    price = F.col("value") + 1.0
    return ev.select(
        F.col("event_type").alias("symbol"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))).alias("date"),
        price.alias("open"),
        price.alias("high"),
        price.alias("low"),
        price.alias("close"),
        (F.col("event_id") % 100 + 1).cast("double").alias("volume"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol registry derived from the brands and their first and last trade."""
    spans = trade_bars(spark, sf_dir).groupBy("symbol").agg(
        F.min("date").alias("first_trade_date"), F.max("date").alias("last_trade_date")
    )
    exchanges = F.array(F.lit("NYSE"), F.lit("NASDAQ"), F.lit("AMEX"))
    return spans.select(
        "symbol",
        F.concat(F.lit("Company "), brand_no().cast("string")).alias("company_name"),
        brand_sector().alias("sector"),
        F.element_at(exchanges, brand_no() % 3 + 1).alias("exchange"),
        "first_trade_date",
        "last_trade_date",
        F.when(brand_no() % 7 == 0, "DELISTED").otherwise("ACTIVE").alias("status"),
    )
