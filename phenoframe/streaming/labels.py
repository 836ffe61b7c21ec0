"""Streams of label events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, label: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and label; events later than ``late`` are dropped, and state is freed with the watermark."""
    t = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if t.isStreaming:
        t = t.withWatermark(ts, late)
    counts = t.groupBy(F.window(ts, every).alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "label", "n")
