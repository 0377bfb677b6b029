"""Symbol registry: load, look up, add, save."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.guards import broadcast_if_small

SCHEMA = (
    "Symbol STRING, CompanyName STRING, Sector STRING, Exchange STRING, "
    "FirstTradeDate DATE, LastTradeDate DATE, Status STRING"
)
COLUMNS = ("symbol", "company_name", "sector", "exchange", "first_trade_date", "last_trade_date", "status")
FILE_COLUMNS = ("Symbol", "CompanyName", "Sector", "Exchange", "FirstTradeDate", "LastTradeDate", "Status")
EXCHANGES = ("NYSE", "NASDAQ", "AMEX")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Read the registry CSV; the seven columns must all be there."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in FILE_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"registry misses columns {missing}")
    df = spark.read.option("header", True).schema(SCHEMA).csv(path, enforceSchema=False)
    named = df.select(*[F.col(f).alias(c) for f, c in zip(FILE_COLUMNS, COLUMNS)])
    return named.withColumn("symbol", F.upper("symbol"))


def save_registry(df: DataFrame, path: str) -> None:
    df.select(*[F.col(c).alias(f) for f, c in zip(FILE_COLUMNS, COLUMNS)]).write.mode("overwrite").csv(
        path, header=True
    )


def first_rows(df: DataFrame, *, seq_col: str | None = None) -> DataFrame:
    """First row per symbol; registries may hold a symbol twice and lookups take the first."""
    if seq_col is None and "seq" in df.columns:
        seq_col = "seq"
    order = F.col(seq_col) if seq_col else F.struct(*[c for c in COLUMNS if c != "symbol"])
    rest = [c for c in df.columns if c != "symbol"]
    return df.groupBy("symbol").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("symbol", "_r.*")


def upsert_symbols(df: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows with a known exchange, in upper case; others are rejected. ``seq`` keeps the order."""
    kept = new.where(F.upper("exchange").isin(*EXCHANGES)).withColumns(
        {"symbol": F.upper("symbol"), "exchange": F.upper("exchange"), "status": F.upper("status")}
    )
    return df.withColumn("seq", F.lit(0)).unionByName(kept.withColumn("seq", F.lit(1)))


def rejected_symbols(new: DataFrame) -> DataFrame:
    return new.where(~F.upper("exchange").isin(*EXCHANGES) | F.col("exchange").isNull())


def symbol_active(symbols: DataFrame, registry: DataFrame) -> DataFrame:
    """(symbol, active): active when its first registry row is ACTIVE in any case."""
    first = first_rows(registry).select(F.upper("symbol").alias("_s"), F.upper("status").alias("_st"))
    return symbols.join(
        broadcast_if_small(first), F.upper(symbols["symbol"]) == F.col("_s"), "left"
    ).select(symbols["symbol"], F.coalesce(F.col("_st") == "ACTIVE", F.lit(False)).alias("active"))


def lookup(symbols: DataFrame, registry: DataFrame, field: str) -> DataFrame:
    """(symbol, field) of the first registry row, NULL when unknown."""
    first = first_rows(registry).select(F.upper("symbol").alias("_s"), F.col(field))
    return symbols.join(broadcast_if_small(first), F.upper(symbols["symbol"]) == F.col("_s"), "left").select(
        symbols["symbol"], field
    )


def symbols_by_sector(registry: DataFrame, sector: str) -> DataFrame:
    return registry.where(F.lower("sector") == sector.lower()).select("symbol")


def active_symbols(registry: DataFrame) -> DataFrame:
    return registry.where(F.upper("status") == "ACTIVE").select("symbol")


def registry_info(registry: DataFrame) -> DataFrame:
    """Counts, and the distinct sectors and exchanges."""
    return registry.agg(
        F.count(F.lit(1)).alias("total_symbols"),
        F.count_if(F.upper(F.col("status")) == "ACTIVE").alias("active_symbols"),
        F.array_sort(F.collect_set("sector")).alias("sectors"),
        F.array_sort(F.collect_set("exchange")).alias("exchanges"),
    )
