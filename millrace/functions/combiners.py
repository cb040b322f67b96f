"""Aggregate functions with a defined result for no rows, for use with any grouping.

Each returns a ``Column`` for ``agg``.  ``python_combiner`` runs a user's create/add/merge/finish
in two phases: partial accumulators in the tasks, then a tree of merges.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Smallest relative deviation of HyperLogLog++ that is passed on: 2^18 registers.
LEAST_RSD = 0.0022


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count() -> Column:
    return F.count(F.lit(1))


def total(c: Column | str) -> Column:
    """Sum; 0 without rows."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def least(c: Column | str) -> Column:
    """Minimum; null without rows."""
    return F.min(col(c))


def greatest(c: Column | str) -> Column:
    return F.max(col(c))


def average(c: Column | str, kind: str = "double") -> Column:
    """Mean; 0 without rows."""
    return F.coalesce(F.avg(col(c)), F.lit(0.0)).cast(kind)


def to_list(*cols: Column | str, order_by: Sequence[Column | str] = ()) -> Column:
    """All values, nulls too; in the order of ``order_by`` if given (else the order is arbitrary)."""
    value = col(cols[0]) if len(cols) == 1 else F.struct(*map(col, cols))
    if order_by:
        pairs = F.sort_array(F.collect_list(F.struct(*(col(c).alias(f"o{i}") for i, c in enumerate(order_by)), value.alias("v"))))
        return F.transform(pairs, lambda x: x["v"])
    return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda x: x["v"])


def to_set(c: Column | str) -> Column:
    """Distinct values, null included, in order."""
    return F.transform(F.array_sort(F.collect_set(F.struct(col(c).alias("v")))), lambda x: x["v"])


def latest(value: Column | str, ts: Column | str, seq: Column | str | None = None) -> Column:
    """Value with the largest timestamp; of equal ones that with the smallest ``seq``."""
    rank = F.struct(col(ts).alias("t"), (-col(seq)).alias("s")) if seq is not None else col(ts)
    return F.max_by(col(value), rank)


def distinct_count(*cols: Column | str) -> Column:
    """Exact number of distinct values; null is a value."""
    return F.count_distinct(F.struct(*map(col, cols)))


def distinct_set(c: Column | str) -> Column:
    return to_set(c)


def approx_distinct(c: Column | str, error: float = 0.01625) -> Column:
    """HyperLogLog++; the default has 2^12 registers."""
    if not 0 < error < 1:
        raise ValueError("error must be between 0 and 1")
    return F.approx_count_distinct(col(c), max(error, LEAST_RSD))


def hll_sketch(c: Column | str, precision: int = 12) -> Column:
    """A mergeable sketch; see hll_union_agg and hll_sketch_estimate."""
    return F.hll_sketch_agg(col(c), F.lit(min(max(precision, 4), 18)))


def _finite(c: Column | str) -> Column:
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def approx_quantiles(c: Column | str, quantiles: Sequence[float], accuracy: int = 10_000) -> Column:
    """Observed values at the quantiles; NaN and infinities don't count; NaN without rows."""
    q = [min(max(x, 0.0), 1.0) for x in quantiles]
    return F.coalesce(F.percentile_approx(_finite(c), F.array(*map(F.lit, q)), F.lit(accuracy)), F.array(*(F.lit(float("nan")) for _ in q)))


def approx_median(c: Column | str, accuracy: int = 10_000) -> Column:
    return F.coalesce(F.percentile_approx(_finite(c), F.lit(0.5), F.lit(accuracy)), F.lit(float("nan")))


def exact_quantiles(c: Column | str, quantiles: Sequence[float]) -> Column:
    """Interpolated quantiles over all values."""
    return F.percentile(_finite(c), F.array(*(F.lit(min(max(x, 0.0), 1.0)) for x in quantiles)))


#: Quantile lists by name.
FIVE_NUMBERS = (0.0, 0.25, 0.5, 0.75, 1.0)
PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def cdf(c: Column | str, at: float) -> Column:
    """Share of finite values up to ``at``; NaN without rows."""
    return F.coalesce(F.avg(F.when(_finite(c).isNotNull(), (_finite(c) <= at).cast("double"))), F.lit(float("nan")))


def top_k(c: Column | str, k: int) -> Column:
    """The k largest values, largest first, repeats kept; for bounded groups (see sets.top_k_per_key for others)."""
    return F.slice(F.sort_array(F.collect_list(col(c)), asc=False), 1, k)


def bottom_k(c: Column | str, k: int) -> Column:
    return F.slice(F.sort_array(F.collect_list(col(c))), 1, k)


def python_combiner(
    df: DataFrame, keys: Sequence[str], value: str, create: Callable[[], object], add: Callable[[object, object], object],
    merge: Callable[[object, object], object], finish: Callable[[object], object], result: str, fanout: int = 64,
) -> DataFrame:
    """A user's combiner per key (or over all rows, without keys): key columns and ``result``, a DDL like "value double".

    Accumulators leave a task once for each key it met; ``fanout`` of a key's accumulators at most meet in a first merge.
    """
    names = list(keys)
    given = [f for f in df.schema.fields if f.name in names]
    made = T.StructType([*given, T.StructField("part", T.LongType()), T.StructField("acc", T.BinaryType())])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, object] = {}
        for batch in batches:
            for key, v in zip(batch[names].itertuples(index=False, name=None) if names else ((),) * len(batch), batch[value], strict=True):
                held[key] = add(held[key] if key in held else create(), v)
        if held:
            part = TaskContext.get().partitionId()
            yield pd.DataFrame([(*k, part, pickle.dumps(a)) for k, a in held.items()], columns=made.names)

    def joined(pdf: pd.DataFrame) -> object:
        acc = None
        for raw in pdf["acc"]:
            acc = pickle.loads(raw) if acc is None else merge(acc, pickle.loads(raw))
        return acc

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        out["acc"] = [pickle.dumps(joined(pdf))]
        return out[made.names]

    final = T.StructType([*given, *T.StructType.fromDDL(result).fields])

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1][names].copy()
        out[final.names[-1]] = [finish(joined(pdf))]
        return out[final.names]

    some = df.select(*names, value).mapInPandas(partial, made).withColumn("part", F.pmod("part", F.lit(fanout)))
    merged = some.groupBy(*names, "part").applyInPandas(first, made)
    done = merged.groupBy(*names).applyInPandas(last, final)
    if names:
        return done
    empty = df.sparkSession.createDataFrame([(finish(create()),)], T.StructType.fromDDL(result))
    return done.unionByName(empty.join(done.select(F.lit(1).alias("_one")).limit(1), F.lit(True), "left_anti"))
