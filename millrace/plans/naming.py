"""Names of steps and scopes, and explain."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Iterator
from contextlib import contextmanager, redirect_stdout

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[str] = []
_NAMES: dict[str, str] = {}


@contextmanager
def named_scope(spark: SparkSession, name: str) -> Iterator[str]:
    """Jobs inside are described by the nested scope's name."""
    _SCOPES.append(name)
    full = "/".join(_SCOPES)
    spark.sparkContext.setJobDescription(full)
    try:
        yield full
    finally:
        _SCOPES.pop()
        spark.sparkContext.setJobDescription("/".join(_SCOPES) or None)


def with_name(df: DataFrame, name: str) -> DataFrame:
    """The frame under a name that shows in explain; inside a scope the name is qualified."""
    full = "/".join([*_SCOPES, name])
    _NAMES[full] = df.schema.simpleString()
    return df.alias(full.replace("/", "."))


def names() -> dict[str, str]:
    """Names given so far, with their schemas."""
    return dict(_NAMES)


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """Spark's plan as text: simple, extended, codegen, cost or formatted."""
    out = io.StringIO()
    with redirect_stdout(out), contextlib.suppress(BrokenPipeError):
        df.explain(mode)
    return out.getvalue()


def snapshot(df: DataFrame) -> dict[str, str]:
    """The plans of a frame by phase."""
    q = df._jdf.queryExecution()
    return {"logical": q.logical().toString(), "optimized": q.optimizedPlan().toString(), "physical": q.executedPlan().toString()}
