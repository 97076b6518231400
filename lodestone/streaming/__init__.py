"""Structured Streaming extensions over event streams; the batch functions take streaming DataFrames as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, key, n) by tumbling or sliding windows; with a stream, late rows are dropped beyond the watermark."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    counts = source.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) by sessions with at most ``gap`` between events."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    counts = source.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
