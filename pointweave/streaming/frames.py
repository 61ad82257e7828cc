"""Streams of frames (an extension): per-frame statistics with watermarks over arriving points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their sums per tumbling window and type; works on batches and on streams."""
    stamped = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = stamped.groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")
