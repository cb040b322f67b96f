"""Fixed-size samples that depend on the seed and the rows only, not on how rows are partitioned.

A row's priority is a seeded hash of its columns (the row itself breaks ties), so the sample is a top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DEFAULT_SEED = 42


def _priority(df: DataFrame, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed).cast("long"), *(F.col(c) for c in df.columns)), *(F.col(c) for c in df.columns)]


def sample_rows(df: DataFrame, k: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """k rows (all, if fewer)."""
    return df.orderBy(*_priority(df, seed)).limit(k)


def sample_list(df: DataFrame, k: int, seed: int = DEFAULT_SEED, into: str = "sample") -> DataFrame:
    """One row with an array of k rows."""
    return sample_rows(df, k, seed).agg(F.collect_list(F.struct(*df.columns)).alias(into))


def sample_rows_per_key(df: DataFrame, keys: str | Sequence[str], k: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """k rows of each key; a window with a rank limit keeps k rows per key in each task before the shuffle."""
    names = [keys] if isinstance(keys, str) else list(keys)
    rank = F.row_number().over(W.partitionBy(*names).orderBy(*_priority(df, seed)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def sample_list_per_key(df: DataFrame, keys: str | Sequence[str], k: int, seed: int = DEFAULT_SEED, into: str = "sample") -> DataFrame:
    names = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in names]
    return sample_rows_per_key(df, names, k, seed).groupBy(*names).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(into))
