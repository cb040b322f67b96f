"""Batches of rows: for Python functions, and as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from millrace.plans.staging import cut


def _chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Regroups Arrow batches into chunks of exactly ``size`` rows; the last may be shorter."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        while len(batch):
            part, batch = batch.iloc[: size - n], batch.iloc[size - n :]
            held.append(part)
            n += len(part)
            if n == size:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def map_batches(df: DataFrame, size: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """``fn`` over chunks of a partition's rows; any number of rows may come back."""
    size = max(size, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches, size):
            yield fn(chunk)

    return df.mapInPandas(run, schema)


def map_values_batches(df: DataFrame, size: int, fn: Callable[[pd.Series], Sequence], value: str, kind: str | T.DataType) -> DataFrame:
    """``fn`` over chunks of a column, across keys; as many values must come back."""
    size = max(size, 1)
    fields = [T.StructField(f.name, T._parse_datatype_string(kind) if isinstance(kind, str) else kind) if f.name == value else f for f in df.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches, size):
            made = list(fn(chunk[value]))
            if len(made) != len(chunk):
                raise ValueError(f"the function returned {len(made)} values for {len(chunk)}")
            yield chunk.assign(**{value: made})

    return df.mapInPandas(run, T.StructType(fields))


def batch_elements(df: DataFrame, size: int, into: str = "batch") -> DataFrame:
    """Arrays of at most ``size`` rows, cut within partitions."""
    size = max(size, 1)
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches, size):
            yield pd.DataFrame({into: [chunk[columns].to_dict("records")]})

    return df.mapInPandas(run, T.StructType([T.StructField(into, T.ArrayType(df.schema))]))


def batch_ordered(df: DataFrame, size: int, order_by: Sequence[str], into: str = "batch") -> DataFrame:
    """batch_no and arrays of exactly ``size`` consecutive rows of the whole order (the last may be shorter).

    Positions come from a range sort: each partition's row count is known before rows are numbered, so no task sees them all.
    """
    size = max(size, 1)
    ordered = df.select(F.struct(*df.columns).alias("_row"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)))
    ranged = ordered.repartitionByRange(*(f"_o{i}" for i in range(len(order_by)))).sortWithinPartitions(*(f"_o{i}" for i in range(len(order_by))))
    placed = cut(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row for each partition
    numbered = placed.join(F.broadcast(before), "_part").withColumn("_p", F.col("_before") + F.col("_at"))
    grouped = numbered.groupBy(F.floor(F.col("_p") / size).alias("batch_no")).agg(F.sort_array(F.collect_list(F.struct("_p", "_row"))).alias("_b"))
    return grouped.select("batch_no", F.transform("_b", lambda x: x["_row"]).alias(into))


def batch_by_size(df: DataFrame, most: int, size: Column, into: str = "batch") -> DataFrame:
    """Greedy batches within partitions whose sizes sum to at most ``most``; a larger row is a batch of its own."""
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        total = 0
        for batch in batches:
            for row, n in zip(batch[columns].to_dict("records"), batch["_size"], strict=True):
                if held and total + n > most:
                    yield pd.DataFrame({into: [held]})
                    held, total = [], 0
                held.append(row)
                total += n
        if held:
            yield pd.DataFrame({into: [held]})

    return df.withColumn("_size", size.cast("long")).mapInPandas(run, T.StructType([T.StructField(into, T.ArrayType(df.schema))]))


def group_into_batches(df: DataFrame, keys: str | Sequence[str], size: int, order_by: Sequence[str], into: str = "batch") -> DataFrame:
    """keys, batch_no and arrays of at most ``size`` rows of a key, in order."""
    if size < 1:
        raise ValueError("a batch has at least one row")
    names = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in names]
    rn = F.row_number().over(W.partitionBy(*names).orderBy(*order_by)) - 1
    numbered = df.withColumn("_rn", rn).withColumn("batch_no", F.floor(F.col("_rn") / size))
    grouped = numbered.groupBy(*names, "batch_no").agg(F.sort_array(F.collect_list(F.struct("_rn", F.struct(*rest).alias("_row")))).alias("_b"))
    return grouped.select(*names, "batch_no", F.transform("_b", lambda x: x["_row"]).alias(into))
