"""Bars and exponential means over unbounded streams.

Bars are event-time windows with a watermark: a bar is final once the watermark passes its end,
rows later than that are dropped.  Exponential means keep (mean, values seen) per symbol in the
state store; micro-batches of a symbol are applied in the order of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(events: DataFrame, *, symbol: str, ts: str, value: str, order: list[Column | str], every: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``symbol, ts, open, high, low, close, volume`` per window start; volume counts events.

    The aggregation is partial before the shuffle, so a symbol with most of the events isn't one task's
    work.  Events with a null symbol, time or value are left out.
    """
    rows = events.where(F.col(symbol).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull()).withWatermark(ts, late)
    frame = F.window(ts, every, slide) if slide else F.window(ts, every)
    key = F.struct(*order)
    bars = rows.groupBy(F.col(symbol).alias("symbol"), frame.alias("w")).agg(
        F.min_by(value, key).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, key).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_sessions(events: DataFrame, *, key: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``key, start, end, n``: runs of events with pauses under ``gap``."""
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    return rows.groupBy(F.col(key), F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def stream_ema(bars: DataFrame, span: int, value: str = "close") -> DataFrame:
    """``symbol, ts, ema``: the exponential mean seeded by the first value, null until ``span`` values were seen."""
    alpha = 2 / (span + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, seen = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("ts")  # the rows of one symbol in one micro-batch
        out = []
        for v in rows["v"]:
            if v == v and v is not None:
                mean = v if mean is None else mean + alpha * (v - mean)
                seen += 1
            out.append(mean if seen >= span else None)
        if mean is not None:
            state.update((float(mean), int(seen)))
        yield pd.DataFrame({"symbol": key[0], "ts": rows["ts"], "ema": pd.Series(out, index=rows.index, dtype="float64")})

    rows = bars.select("symbol", "ts", F.col(value).cast("double").alias("v")).where("symbol is not null and ts is not null")
    return rows.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, ema double", "mean double, seen long", "append", GroupStateTimeout.NoTimeout)
