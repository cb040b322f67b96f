"""Limits, top-k, union and distinct."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def take(df: DataFrame, n: int, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """n rows of all, anywhere in a plan; the first n in the order, if one is given."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def first(df: DataFrame, order_by: Sequence[str | Column] = ()) -> DataFrame:
    return take(df, 1, order_by)


def _per_key(df: DataFrame, keys: str | Sequence[str], order: list[Column], k: int) -> DataFrame:
    names = [keys] if isinstance(keys, str) else list(keys)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*names).orderBy(*order))).where(F.col("rank") <= k)


def top_k_globally(df: DataFrame, value: str, k: int, into: str = "top") -> DataFrame:
    """One array, largest first, repeats kept."""
    best = df.select(value).orderBy(F.desc(value)).limit(k)
    return best.agg(F.sort_array(F.collect_list(value), asc=False).alias(into))


def bottom_k_globally(df: DataFrame, value: str, k: int, into: str = "bottom") -> DataFrame:
    return df.select(value).orderBy(value).limit(k).agg(F.sort_array(F.collect_list(value)).alias(into))


def top_k_per_key(df: DataFrame, keys: str | Sequence[str], value: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The k rows of each key with the largest value, with ``rank``; Spark limits ranks within tasks before it shuffles."""
    return _per_key(df, keys, [F.desc(value), *map(F.col, ties)], k)


def bottom_k_per_key(df: DataFrame, keys: str | Sequence[str], value: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    return _per_key(df, keys, [F.asc(value), *map(F.col, ties)], k)


def flatten(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, repeats kept."""
    if not frames:
        raise ValueError("flatten needs at least one frame")
    return reduce(DataFrame.unionByName, frames)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def distinct_per_key(df: DataFrame, keys: str | Sequence[str], value: str) -> DataFrame:
    names = [keys] if isinstance(keys, str) else list(keys)
    return df.select(*names, value).distinct()


def distinct_by(df: DataFrame, keys: str | Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the order given."""
    names = [keys] if isinstance(keys, str) else list(keys)
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*names).orderBy(*order_by))).where("_rank = 1").drop("_rank")


def collect_sorted(df: DataFrame, *by: str | Column) -> list:
    """To the driver, in order."""
    return df.orderBy(*(by or df.columns)).collect()
