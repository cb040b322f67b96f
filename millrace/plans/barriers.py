"""Redistribution, and ordering of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def reshuffle(df: DataFrame, n: int | None = None, *keys: str) -> DataFrame:
    """Even partitions; by ``keys``, if the next step groups or joins on them (one shuffle serves both)."""
    parts = n or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts, *keys)


def wait_on(data: DataFrame, *signals: DataFrame) -> DataFrame:
    """``data``, after every signal has been computed to its end."""
    for s in signals:
        s.write.format("noop").mode("overwrite").save()
    return data


def cached(df: DataFrame) -> DataFrame:
    """Computed once, when first used, for several uses."""
    return df.persist()


def to_map(df: DataFrame, key: str = "key", value: str = "value") -> dict:
    """To the driver, for small results; of a repeated key one value stays."""
    return {r[key]: r[value] for r in df.select(key, value).collect()}
