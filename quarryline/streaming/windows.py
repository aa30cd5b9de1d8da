"""Event-time aggregates over streams and tables: tumbling, sliding and session windows with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, ts: str, width: str, keys: list[str], aggregates: list[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, window_end, keys and aggregates. slide: windows begin this often (none: tumbling).
    late: how long a stream waits for rows; it bounds the state, and rows that come later are dropped.
    Rows without a time are in no window."""
    df = df.withWatermark(ts, late) if late else df
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = df.groupBy(window.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *out.columns[1:])


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    """As `windowed`, for sessions that end when `gap` passes without a row of the keys."""
    df = df.withWatermark(ts, late) if late else df
    out = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *out.columns[1:])
