"""Structured Streaming: bars over event time, and a running average that keeps state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(events: DataFrame, width: str = "1 day", late: str = "1 hour", key: str = "event_type", time: str = "ts", value: str = "value", order: str | None = None) -> DataFrame:
    """Open, high, low, close and count of each key and window; a stream's events later than ``late`` are left
    out. Works on a batch as on a stream. Open and close are the first and last event with a value by time, then by ``order``, then by value."""
    place = F.when(F.col(value).isNotNull(), F.struct(time, *([order] if order else []), value))
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, width).alias("bar"), key)
        .agg(F.min_by(value, place).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, place).alias("close"), F.count("*").alias("n"))
        .select(key, F.col("bar.start").alias("bar"), "open", "high", "low", "close", "n")
    )


def running_sma(stream: DataFrame, n: int = 7, m: int = 2, key: str = "code", time: str = "ts", value: str = "value") -> DataFrame:
    """(key, time, y) with y = (m x + (n - m) y before) / n along each key's stream; a null keeps y."""
    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else None
        out = []
        for rows in frames:
            for t, x in rows.sort_values(time)[[time, value]].itertuples(index=False):
                if x == x and x is not None:
                    y = x if y is None else (m * x + (n - m) * y) / n
                out.append((k[0], t, y))
        if y is not None:
            state.update((float(y),))
        yield pd.DataFrame(out, columns=[key, time, "y"])

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {time} timestamp, y double", "y double", "append", GroupStateTimeout.NoTimeout)
