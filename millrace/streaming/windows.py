"""Event-time windows, the same for batch and streaming frames. An extension: nothing above depends on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their summed value per tumbling window and type; a stream drops events later than the watermark."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")
