"""An extension: count matrices kept up from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """``(window_start, cell_id, gene_id, value)`` per event-time window, late rows dropped after the watermark."""
    got = events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene_id"))
    return got.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.col("w.start").alias("window_start"), "cell_id", "gene_id", "value")
