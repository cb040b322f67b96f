"""The batch windows over Structured Streaming sources, with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def combine_per_window(stream: DataFrame, ts: str, size: str, late: str, keys: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    """Aggregates of each tumbling window; rows later than ``late`` are dropped and windows close by the watermark."""
    done = stream.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return done.select(F.col("window")["start"].alias("window_start"), F.col("window")["end"].alias("window_end"), *keys, *aggregates)
