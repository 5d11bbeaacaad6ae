"""Bars (symbol, ts, open, high, low, close, volume) from event tables, files and a random walk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANONICAL = ("open", "high", "low", "close", "volume")


def pack_order(high: Column, low: Column, low_digits: int) -> Column:
    """Two whole numbers as one sortable decimal; ``low`` has at most ``low_digits`` digits and isn't negative."""
    wide = "decimal(38,0)"
    return (high.cast("decimal(20,0)") * F.lit(10**low_digits).cast("decimal(18,0)")).cast(wide) + low.cast(wide)


def bars_from(df: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, order: Column) -> DataFrame:
    """One bar per (symbol, ts): open and close are the first and last price by ``order``.

    A single hash aggregation with map-side partial bars, so a symbol with most of the rows is no hot
    key of a sort; ``order`` should be a number, timestamp or decimal (see :func:`pack_order`), for
    which no sort is needed, and unique in a bar.  Rows with a null symbol, time or price are left out.
    """
    rows = df.select(symbol.alias("symbol"), ts.cast("timestamp").alias("ts"), price.cast("double").alias("price"), volume.cast("double").alias("v"), order.alias("o"))
    rows = rows.where("symbol is not null and ts is not null and price is not null")
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"), F.sum("v").alias("volume")
    )


LINEITEM_BARS_SQL = """
SELECT l_returnflag AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts, arg_min(l_extendedprice, o) AS open, max(l_extendedprice) AS high,
  min(l_extendedprice) AS low, arg_max(l_extendedprice, o) AS close, sum(l_quantity) AS volume
FROM (SELECT *, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice, 'f': l_quantity} AS o FROM lineitem) GROUP BY 1, 2"""


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = pack_order(F.col("l_orderkey"), F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey"), 14)
    return bars_from(df, F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice"), F.col("l_quantity"), order)


EVENT_BARS_SQL = """
SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)) AS ts, arg_min(value, o) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, o) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM (SELECT *, {'a': ts, 'b': event_id} AS o FROM events WHERE value IS NOT NULL) GROUP BY 1, 2"""


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event values, one symbol per event type."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    return bars_from(df, F.col("event_type"), F.date_trunc("hour", F.col("ts").cast("timestamp")), F.col("value"), F.lit(1.0), pack_order(F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"), 12))


def canonical_columns(df: DataFrame) -> DataFrame:
    """The five bar columns in lower case, unless a lower-case twin exists; other columns stay as they are."""
    have = set(df.columns)
    return df.withColumnsRenamed({c: c.lower() for c in df.columns if c.lower() in CANONICAL and c != c.lower() and c.lower() not in have})


def csv_bars(spark: SparkSession, path: str, symbol: str, time_column: str = "timestamp") -> DataFrame:
    """Bars of one symbol from CSV with a header; prices that are no numbers are null."""
    raw = spark.read.option("header", True).csv(path)
    df = canonical_columns(raw)
    return df.select(F.lit(symbol).alias("symbol"), F.to_timestamp(time_column).alias("ts"), *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in CANONICAL])


def sample_ohlcv(spark: SparkSession, rows: int = 200, trend: str = "up", start_price: float = 100.0, volatility: float = 0.02, seed: int = 10, symbol: str = "SAMPLE") -> DataFrame:
    """A seeded geometric random walk of daily bars from 2024-01-01 with a drift of -0.4 % (down), 0 (flat) or 0.4 % (up) a day."""
    drift = {"down": -0.004, "flat": 0.0, "up": 0.004}
    if trend not in drift:
        raise ValueError(f"trend must be one of {sorted(drift)}")
    if rows < 1 or start_price <= 0 or volatility < 0:
        raise ValueError("rows and start_price must be positive, volatility not negative")
    rng = np.random.default_rng(seed)
    close = start_price * np.exp(np.cumsum(drift[trend] + volatility * rng.standard_normal(rows)))
    opened = np.concatenate(([start_price], close[:-1]))
    reach = np.abs(rng.standard_normal((2, rows))) * volatility / 2
    pdf = pd.DataFrame({
        "symbol": symbol, "ts": pd.date_range("2024-01-01", periods=rows, freq="D"), "open": opened, "high": np.maximum(opened, close) * (1 + reach[0]),
        "low": np.minimum(opened, close) * (1 - reach[1]), "close": close, "volume": rng.uniform(1000, 5000, rows),
    })
    return spark.createDataFrame(pdf)
