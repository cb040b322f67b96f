"""Filters.  Null is a value: it differs from every other value and equals itself; comparisons by size never keep it, or NaN."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.transforms import Expr, expr


def _sized(df: DataFrame, column: str, test: Callable[[Column], Column]) -> DataFrame:
    keep = test(F.col(column))
    if isinstance(df.schema[column].dataType, T.DoubleType | T.FloatType):
        keep &= ~F.isnan(column)
    return df.where(keep)


def filter_rows(df: DataFrame, predicate: Expr) -> DataFrame:
    return df.where(expr(predicate))


def filter_eq(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column).eqNullSafe(F.lit(value)))


def filter_ne(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def filter_lt(df: DataFrame, column: str, value: object) -> DataFrame:
    return _sized(df, column, lambda c: c < F.lit(value))


def filter_le(df: DataFrame, column: str, value: object) -> DataFrame:
    return _sized(df, column, lambda c: c <= F.lit(value))


def filter_gt(df: DataFrame, column: str, value: object) -> DataFrame:
    return _sized(df, column, lambda c: c > F.lit(value))


def filter_ge(df: DataFrame, column: str, value: object) -> DataFrame:
    return _sized(df, column, lambda c: c >= F.lit(value))


def filter_range(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """low <= column < high."""
    return _sized(df, column, lambda c: (c >= F.lit(low)) & (c < F.lit(high)))


def filter_range_inclusive(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    return _sized(df, column, lambda c: c.between(F.lit(low), F.lit(high)))


def filter_by(df: DataFrame, field: Expr, predicate: Callable[[Column], Column]) -> DataFrame:
    """Tests an expression of the row."""
    return df.where(predicate(expr(field)))


def filter_values(df: DataFrame, predicate: Expr) -> DataFrame:
    """Tests the value as it is at this place of the plan."""
    return df.where(expr(predicate))
