"""Windowed sums over an event table, the same plan for a batch and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, event_type, n, total. On a stream, rows later than ``late`` are left out and windows close behind it."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    windows = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windows.select(F.col("window.start").alias("hour"), "event_type", "n", "total")
