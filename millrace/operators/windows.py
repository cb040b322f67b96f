"""Tumbling event-time windows, half-open, as ``window`` with start and end in milliseconds since the epoch.

Times before the offset fall into windows before it (floor, not truncation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import combiners as C


def millis(ts: Column | str) -> Column:
    """Milliseconds since the epoch; numbers are taken as such, times without a zone as UTC in a UTC session."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(c.cast("timestamp"))


def tumble(ms: Column, size_ms: int, offset_ms: int = 0) -> Column:
    """The window of a time in milliseconds."""
    if size_ms <= 0:
        raise ValueError("a window's size is positive")
    start = ms - F.pmod(ms - F.lit(offset_ms), F.lit(size_ms))
    return F.struct(start.alias("start"), (start + size_ms).alias("end"))


def key_by_window(df: DataFrame, ts: str, size_ms: int, offset_ms: int = 0, into: str = "window") -> DataFrame:
    return df.withColumn(into, tumble(millis(ts), size_ms, offset_ms))


def combine_per_window(df: DataFrame, ts: str, size_ms: int, offset_ms: int = 0, keys: Sequence[str] = (), **aggregates: Column) -> DataFrame:
    """window_start, window_end (milliseconds), the keys, and the aggregates of each window that has rows."""
    w = key_by_window(df, ts, size_ms, offset_ms, "_window")
    done = w.groupBy("_window", *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return done.select(F.col("_window")["start"].alias("window_start"), F.col("_window")["end"].alias("window_end"), *keys, *aggregates)


def group_by_window(df: DataFrame, ts: str, value: str, size_ms: int, offset_ms: int = 0, keys: Sequence[str] = (), order_by: Sequence[str] = ()) -> DataFrame:
    return combine_per_window(df, ts, size_ms, offset_ms, keys, values=C.to_list(value, order_by=order_by))


def sum_per_window(df: DataFrame, ts: str, value: str, size_ms: int, offset_ms: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    return combine_per_window(df, ts, size_ms, offset_ms, keys, sum=C.total(value))


def count_per_window(df: DataFrame, ts: str, size_ms: int, offset_ms: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    return combine_per_window(df, ts, size_ms, offset_ms, keys, count=C.count())


def min_per_window(df: DataFrame, ts: str, value: str, size_ms: int, offset_ms: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    return combine_per_window(df, ts, size_ms, offset_ms, keys, min=C.least(value))


def max_per_window(df: DataFrame, ts: str, value: str, size_ms: int, offset_ms: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    return combine_per_window(df, ts, size_ms, offset_ms, keys, max=C.greatest(value))


def average_per_window(df: DataFrame, ts: str, value: str, size_ms: int, offset_ms: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    return combine_per_window(df, ts, size_ms, offset_ms, keys, average=C.average(value))
