"""Row transforms.

Expressions (``Column`` or SQL text) stay in Catalyst.  A Python callable goes through Arrow: it
receives a pandas DataFrame for each batch and returns one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Expr = Column | str


def expr(e: Expr) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def map_rows(df: DataFrame, **columns: Expr) -> DataFrame:
    """One row for each row, with exactly these columns."""
    return df.select(*(expr(e).alias(name) for name, e in columns.items()))


def map_python(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """``fn`` over batches of rows; any number of rows may come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def flat_map(df: DataFrame, array: Expr, into: str = "value") -> DataFrame:
    """A row for each element of an array expression; none for an empty or null array."""
    return df.select(F.explode(expr(array)).alias(into))


def filter_map(df: DataFrame, value: Expr, into: str = "value") -> DataFrame:
    """The expression where it isn't null."""
    return df.select(expr(value).alias(into)).where(F.col(into).isNotNull())


def key_by(df: DataFrame, key: Expr, into: str = "key") -> DataFrame:
    return df.withColumn(into, expr(key))


with_keys = key_by


def with_constant_key(df: DataFrame, key: object, into: str = "key") -> DataFrame:
    return df.withColumn(into, F.lit(key))


def keys(df: DataFrame, *names: str) -> DataFrame:
    """The key columns, repeated rows kept."""
    return df.select(*(names or ("key",)))


def values(df: DataFrame, *key_names: str) -> DataFrame:
    """All columns but the key."""
    return df.drop(*(key_names or ("key",)))


def swap_keys(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    return df.select(F.col(value).alias(key), F.col(key).alias(value))


def map_values(df: DataFrame, value: Expr, into: str = "value") -> DataFrame:
    """A new value, the other columns as they are."""
    return df.withColumn(into, expr(value))


def to_display_string(df: DataFrame, column: str = "value", into: str = "value") -> DataFrame:
    """Text of a value; whole doubles are written without a fraction."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.DoubleType | T.FloatType):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return df.select(F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string")).alias(into))
    return df.select(c.cast("string").alias(into))


def attach_timestamps(df: DataFrame, millis: Expr, into: str = "ts") -> DataFrame:
    """Event time from milliseconds since the epoch."""
    return df.withColumn(into, F.timestamp_millis(expr(millis).cast("long")))


def to_timestamped(df: DataFrame, millis: str, value: str) -> DataFrame:
    return df.select(F.timestamp_millis(F.col(millis).cast("long")).alias("ts"), F.col(value).alias("value"))


def reify_timestamps(df: DataFrame, ts: str = "ts", into: str = "ts_ms") -> DataFrame:
    """Event time back to milliseconds, in a column of its own."""
    return df.select(F.unix_millis(F.col(ts).cast("timestamp")).alias(into), *(c for c in df.columns if c != ts))


def log_rows(df: DataFrame, write: Callable[[str], None] = print, form: Callable[[dict], str] = str) -> DataFrame:
    """Passes rows through and writes each, where it is, when the plan runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                write(form(row))
            yield batch

    return df.mapInPandas(run, df.schema)


def compose(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies reusable pieces of a plan one after another."""
    for step in steps:
        df = df.transform(step)
    return df


def from_rows(spark, rows: Iterable, schema: str | T.StructType) -> DataFrame:
    """An in-memory source; the schema is always given."""
    return spark.createDataFrame(list(rows), schema)
