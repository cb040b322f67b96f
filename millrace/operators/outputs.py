"""Several outputs of one input, and errors as data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def partition(df: DataFrame, **tests: Column) -> dict[str, DataFrame]:
    """One frame for each test; a row is in every one whose test is true.  Persist ``df`` first if it is costly."""
    return {name: df.where(test) for name, test in tests.items()}


def partition_by(df: DataFrame, tag: Column, *names: str) -> dict[str, DataFrame]:
    """One frame for each value of a discriminator."""
    marked = df.withColumn("_tag", tag)
    return {name: marked.where(F.col("_tag") == name).drop("_tag") for name in names}


def tee(df: DataFrame, n: int = 2) -> list[DataFrame]:
    """n handles of the same plan."""
    return [df] * n


def try_map(df: DataFrame, fn: Callable[[dict], object], kind: str, into: str = "result") -> DataFrame:
    """The rows with struct<value, error>: what ``fn`` returned for the row, or the text of what it raised."""
    schema = T.StructType([*df.schema.fields, T.StructField(into, T._parse_datatype_string(f"struct<value:{kind},error:string>"))])

    def one(row: dict) -> dict:
        try:
            return {"value": fn(row), "error": None}
        except Exception as e:  # noqa: BLE001  the error is the result
            return {"value": None, "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{into: [one(r) for r in batch.to_dict("records")]})

    return df.mapInPandas(run, schema)


def _split(tried: DataFrame, good: Callable[[DataFrame], DataFrame], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    failed = tried.where(F.col("result")["error"].isNotNull())
    dead = failed.select(F.struct(*columns).alias("element"), F.col("result")["error"].alias("error"))
    return good(tried.where(F.col("result")["error"].isNull())), dead


def map_catching(df: DataFrame, fn: Callable[[dict], object], kind: str, into: str = "value") -> tuple[DataFrame, DataFrame]:
    """Good values, and dead letters: element and error.

    Both read one plan, so ``fn`` runs for each; persist or stage it between if it is costly.
    """
    return _split(try_map(df, fn, kind), lambda ok: ok.select(F.col("result")["value"].alias(into)), df.columns)


def flat_map_catching(df: DataFrame, fn: Callable[[dict], list], kind: str, into: str = "value") -> tuple[DataFrame, DataFrame]:
    """Like map_catching for functions that return a list; each element is a row."""
    return _split(try_map(df, fn, f"array<{kind}>"), lambda ok: ok.select(F.explode(F.col("result")["value"]).alias(into)), df.columns)


def try_flat_map(df: DataFrame, fn: Callable[[dict], list], kind: str, into: str = "result") -> DataFrame:
    return try_map(df, fn, f"array<{kind}>", into)


def expression_catching(df: DataFrame, value: Column, message: str, into: str = "value") -> tuple[DataFrame, DataFrame]:
    """For expressions that are null where they fail (try_cast, try_divide and so on), all in the JVM."""
    marked = df.withColumn("_value", value)
    dead = marked.where(F.col("_value").isNull()).select(F.struct(*df.columns).alias("element"), F.lit(message).alias("error"))
    return marked.where(F.col("_value").isNotNull()).withColumn(into, F.col("_value")).drop("_value"), dead


def collect_fail_fast(tried: DataFrame, result: str = "result") -> list:
    """Values to the driver; the first error ends the job."""
    r = F.col(result)
    return [x[0] for x in tried.select(F.when(r["error"].isNull(), r["value"]).otherwise(F.raise_error(r["error"]).cast(tried.schema[result].dataType["value"].dataType))).collect()]
