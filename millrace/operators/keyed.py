"""Grouping and aggregation, per key and over all rows.

Aggregates are declared, never collected and reduced: Spark combines partially before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import combiners as C

Keys = str | Sequence[str]


def _names(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def combine_per_key(df: DataFrame, keys: Keys, **aggregates: Column) -> DataFrame:
    """One row for each key (null keys included) with the named aggregates."""
    return df.groupBy(*_names(keys)).agg(*(a.alias(n) for n, a in aggregates.items()))


def combine_globally(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Exactly one row, also of no rows."""
    return df.agg(*(a.alias(n) for n, a in aggregates.items()))


def combine_salted(df: DataFrame, keys: Keys, partial: dict[str, Column], final: dict[str, Column], fanout: int = 16) -> DataFrame:
    """Two-level aggregation for aggregates that Spark can't combine before its shuffle: first per key and salt, then per key."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(fanout))
    first = df.withColumn("_salt", salt).groupBy(*_names(keys), "_salt").agg(*(a.alias(n) for n, a in partial.items()))
    return first.groupBy(*_names(keys)).agg(*(a.alias(n) for n, a in final.items()))


def group_by_key(df: DataFrame, keys: Keys, *value: str, into: str = "values", order_by: Sequence[str] = ()) -> DataFrame:
    """All values of each key in an array, nulls kept."""
    names = _names(keys)
    return df.groupBy(*names).agg(C.to_list(*(value or [c for c in df.columns if c not in names]), order_by=order_by).alias(into))


def count_globally(df: DataFrame, into: str = "count") -> DataFrame:
    return combine_globally(df, **{into: C.count()})


def count_per_element(df: DataFrame, *columns: str, into: str = "count") -> DataFrame:
    """How often each row (or combination of ``columns``) occurs."""
    return df.groupBy(*(columns or df.columns)).agg(C.count().alias(into))


def count_per_key(df: DataFrame, keys: Keys, into: str = "count") -> DataFrame:
    return combine_per_key(df, keys, **{into: C.count()})


def sum_globally(df: DataFrame, c: str, into: str = "sum") -> DataFrame:
    return combine_globally(df, **{into: C.total(c)})


def min_globally(df: DataFrame, c: str, into: str = "min") -> DataFrame:
    return combine_globally(df, **{into: C.least(c)})


def max_globally(df: DataFrame, c: str, into: str = "max") -> DataFrame:
    return combine_globally(df, **{into: C.greatest(c)})


def average_globally(df: DataFrame, c: str, into: str = "average") -> DataFrame:
    return combine_globally(df, **{into: C.average(c)})


def mean_globally(df: DataFrame, c: str, kind: str = "double", into: str = "mean") -> DataFrame:
    return combine_globally(df, **{into: C.average(c, kind)})


def sum_per_key(df: DataFrame, keys: Keys, c: str, into: str = "sum") -> DataFrame:
    return combine_per_key(df, keys, **{into: C.total(c)})


def min_per_key(df: DataFrame, keys: Keys, c: str, into: str = "min") -> DataFrame:
    return combine_per_key(df, keys, **{into: C.least(c)})


def max_per_key(df: DataFrame, keys: Keys, c: str, into: str = "max") -> DataFrame:
    return combine_per_key(df, keys, **{into: C.greatest(c)})


def average_per_key(df: DataFrame, keys: Keys, c: str, into: str = "average") -> DataFrame:
    return combine_per_key(df, keys, **{into: C.average(c)})


def mean_per_key(df: DataFrame, keys: Keys, c: str, kind: str = "double", into: str = "mean") -> DataFrame:
    return combine_per_key(df, keys, **{into: C.average(c, kind)})


def to_list_globally(df: DataFrame, c: str, into: str = "values", order_by: Sequence[str] = ()) -> DataFrame:
    return combine_globally(df, **{into: C.to_list(c, order_by=order_by)})


def to_set_globally(df: DataFrame, c: str, into: str = "values") -> DataFrame:
    return combine_globally(df, **{into: C.to_set(c)})


def to_list_per_key(df: DataFrame, keys: Keys, c: str, into: str = "values", order_by: Sequence[str] = ()) -> DataFrame:
    return combine_per_key(df, keys, **{into: C.to_list(c, order_by=order_by)})


def to_set_per_key(df: DataFrame, keys: Keys, c: str, into: str = "values") -> DataFrame:
    return combine_per_key(df, keys, **{into: C.to_set(c)})


def to_dict(df: DataFrame, key: str, value: str, order_by: str, into: str = "map") -> DataFrame:
    """One map; of a repeated key the last value in ``order_by`` stays.  Null keys, which a map can't hold, are left out."""
    last = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(value), order_by)[value].alias(value))
    return last.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(into))


def latest_globally(df: DataFrame, value: str, ts: str, seq: str | None = None, into: str = "latest") -> DataFrame:
    return combine_globally(df, **{into: C.latest(value, ts, seq)})


def latest_per_key(df: DataFrame, keys: Keys, value: str, ts: str, seq: str | None = None, into: str = "latest") -> DataFrame:
    return combine_per_key(df, keys, **{into: C.latest(value, ts, seq)})


def distinct_count_globally(df: DataFrame, c: str, into: str = "distinct") -> DataFrame:
    return combine_globally(df, **{into: C.distinct_count(c)})


def distinct_count_per_key(df: DataFrame, keys: Keys, c: str, into: str = "distinct") -> DataFrame:
    return combine_per_key(df, keys, **{into: C.distinct_count(c)})


def approx_count_distinct(df: DataFrame, c: str, error: float = 0.01625, into: str = "distinct") -> DataFrame:
    return combine_globally(df, **{into: C.approx_distinct(c, error)})


def approx_count_distinct_per_key(df: DataFrame, keys: Keys, c: str, error: float = 0.01625, into: str = "distinct") -> DataFrame:
    return combine_per_key(df, keys, **{into: C.approx_distinct(c, error)})


def kmv_distinct(df: DataFrame, c: str, k: int = 256, keys: Keys = (), into: str = "distinct") -> DataFrame:
    """k minimum values: exact below k distinct values, else (k - 1) / the k-th smallest hash as a share of the range.

    Every group's k smallest hashes are found by map-side distinct and a bounded window.
    """
    k, names = max(k, 4), _names(keys)
    if not names:
        rest = df.select(F.xxhash64(c).alias("_h")).distinct().orderBy("_h").limit(k)
        ranked = rest.agg(F.count(F.lit(1)).alias("_n"), F.max("_h").alias("_h"))
        return ranked.select(_kmv(k).alias(into))
    hashes = df.select(*names, F.xxhash64(c).alias("_h")).distinct()
    ranked = hashes.withColumn("_r", F.row_number().over(W.partitionBy(*names).orderBy("_h"))).where(F.col("_r") <= k)
    return ranked.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.max("_h").alias("_h")).select(*names, _kmv(k).alias(into))


def _kmv(k: int) -> Column:
    share = (F.col("_h").cast("double") + 2.0**63) / 2.0**64
    return F.when(F.col("_n") < k, F.col("_n").cast("double")).otherwise((k - 1) / share)


def approx_median_globally(df: DataFrame, c: str, into: str = "median") -> DataFrame:
    return combine_globally(df, **{into: C.approx_median(c)})


def approx_quantiles_globally(df: DataFrame, c: str, quantiles: Sequence[float], into: str = "quantiles") -> DataFrame:
    return combine_globally(df, **{into: C.approx_quantiles(c, quantiles)})


def approx_median_per_key(df: DataFrame, keys: Keys, c: str, into: str = "median") -> DataFrame:
    return combine_per_key(df, keys, **{into: C.approx_median(c)})


def approx_quantiles_per_key(df: DataFrame, keys: Keys, c: str, quantiles: Sequence[float], into: str = "quantiles") -> DataFrame:
    return combine_per_key(df, keys, **{into: C.approx_quantiles(c, quantiles)})
