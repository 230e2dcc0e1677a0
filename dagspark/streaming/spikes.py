"""Streaming forms: the stateless operators work on streams as they are; the PSTH becomes a windowed count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(stream: DataFrame, bin_seconds: float = 60.0, late_seconds: float = 300.0, time: str = "ts", unit: str | None = "event_type") -> DataFrame:
    """Counts of each unit in tumbling bins of event time; a bin is final once the watermark has passed it."""
    keys = [F.window(time, f"{bin_seconds} seconds").alias("bin"), *([F.col(unit).alias("unit")] if unit else [])]
    counted = stream.withWatermark(time, f"{late_seconds} seconds").groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("bin.start").alias("bin_start"), *(["unit"] if unit else []), F.col("n").cast("double").alias("count"))
