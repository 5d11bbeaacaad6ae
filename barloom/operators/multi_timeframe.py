"""Higher time frames: bucketed closes, their trend, and the as-of join back onto the bars."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.indicators import compute

_UNITS = {"min": 60, "t": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds_of(timeframe: str) -> int:
    """Seconds of a time frame such as 15min, 4h, 1d."""
    m = re.fullmatch(r"\s*(\d*)\s*(min|t|h|d|w)\s*", timeframe.lower())
    if not m or not int(m[1] or 1):
        raise ValueError(f"unknown time frame {timeframe!r}")
    return int(m[1] or 1) * _UNITS[m[2]]


def resample_last(bars: DataFrame, timeframe: str, value: str = "close") -> DataFrame:
    """The last non-null value of each bucket, right-closed and labelled by its right edge (buckets from the epoch)."""
    n = seconds_of(timeframe)
    micros = F.unix_micros("ts")
    edge = F.timestamp_micros(F.ceil(micros / F.lit(n * 1_000_000)).cast("long") * F.lit(n * 1_000_000))
    return bars.where(F.col(value).isNotNull()).groupBy("symbol", edge.alias("label")).agg(F.max_by(value, "ts").alias(value)).withColumnRenamed("label", "ts")


def asof_join(left: DataFrame, right: DataFrame, value: str, *, by: str = "symbol", on: str = "ts") -> DataFrame:
    """``left`` with the ``value`` of the latest ``right`` row at or before it; null values of ``right`` count as values.

    One union, one sort by (by, on), one running last: no join of ranges.
    """
    held = F.struct(F.col(value).alias("v"))
    none = F.lit(None).cast(f"struct<v:{right.schema[value].dataType.simpleString()}>")
    cols = [c for c in left.columns if c != value]
    a = left.select(*cols, none.alias("__held"), F.lit(1).alias("__side"))
    b = right.select(by, on, held.alias("__held"), F.lit(0).alias("__side"))
    w = Window.partitionBy(by).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__seen", F.last("__held", True).over(w))
    return both.where("__side = 1").select(*cols, F.col("__seen.v").alias(value))


def multi_tf_slope(bars: DataFrame, higher_tf: str = "1d", window: int = 10, value: str = "close") -> DataFrame:
    """``higher_tf_slope``: change of the higher frame's EMA relative to its mean size, as known at each bar.

    Null where the symbol has fewer than window + 2 higher bars or none has closed yet.
    """
    higher = resample_last(bars.select("symbol", "ts", value), higher_tf, value)
    e = compute(higher, "EMA", {"window": window}, inputs={"close": value})
    w = Window.partitionBy("symbol").orderBy("ts")
    size = F.avg(F.abs("ema")).over(w.rowsBetween(-(window - 1), 0))
    e = e.withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    slope = F.when(F.col("n") >= window + 2, F.expr("ema - lag(ema) OVER (PARTITION BY symbol ORDER BY ts)") / F.nullif(size, F.lit(0.0)))
    return asof_join(bars, e.select("symbol", "ts", slope.alias("higher_tf_slope")), "higher_tf_slope")


def multi_tf_trend(bars: DataFrame, higher_tf: str = "1d", window: int = 10, slope_threshold: float = 0.0) -> DataFrame:
    """``higher_tf_trend``: 1, -1 or 0 by the slope's size against the threshold."""
    s = F.col("higher_tf_slope")
    sign = F.when(s > slope_threshold, 1.0).when(s < -slope_threshold, -1.0).when(s.isNotNull(), 0.0)
    return multi_tf_slope(bars, higher_tf, window).withColumn("higher_tf_trend", sign).drop("higher_tf_slope")


def slope_sql(bars_sql: str, seconds: int, window: int) -> str:
    """The same for DuckDB, with its own as-of join."""
    a = 2 / (window + 1)
    return f"""
WITH bars AS ({bars_sql}),
h AS (SELECT symbol, make_timestamp(CAST(ceil(epoch_us(ts) / {seconds}000000.0) AS BIGINT) * {seconds}000000) AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n FROM h),
e AS (SELECT symbol, ts, r, n, CASE WHEN r + 1 >= {window} THEN pow({1 - a!r}, r) * sum(close * CASE WHEN r = 0 THEN 1.0 ELSE {a!r} END * pow({1 - a!r}, -r)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) END AS ema FROM r),
s AS (SELECT symbol, ts, CASE WHEN n >= {window + 2} THEN (ema - lag(ema) OVER (PARTITION BY symbol ORDER BY ts)) / nullif(avg(abs(ema)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW), 0) END AS higher_tf_slope FROM e)
SELECT b.symbol, b.ts, s.higher_tf_slope FROM bars b ASOF LEFT JOIN s ON b.symbol = s.symbol AND b.ts >= s.ts"""
