"""Bars from a stream of events: tumbling windows with a watermark, and keyed exponential means."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream (event_id, ts, event_type, value); a bar is final once the watermark is past it."""
    order = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late).groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("trades"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "trades")
    )


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events of a type with no gap as long as ``gap``."""
    return (
        events.withWatermark("ts", late).groupBy(F.col("event_type").alias("symbol"), F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
    )


def stream_ema(bars: DataFrame, n: int = 20) -> DataFrame:
    """Exponential mean of closes per symbol, carried from batch to batch."""
    a = 2 / (n + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        for pdf in frames:
            pdf = pdf.sort_values("ts", kind="stable")
            out = []
            for x in pdf["close"]:
                value = x if value is None else value + a * (x - value)
                out.append(value)
            yield pd.DataFrame({"symbol": key[0], "ts": pdf["ts"].to_numpy(), "ema": out})
        state.update((value,))

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, ema double", "value double", "append", GroupStateTimeout.NoTimeout)
