"""Validation rules as expressions, and what to do with rows that break them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS = "array<struct<field:string,message:string,code:string>>"


@dataclass(frozen=True)
class Rule:
    """``ok`` is true for valid rows; null counts as broken."""

    field: str
    ok: Column
    message: str
    code: str

    def errors(self) -> Column:
        found = F.array(F.struct(F.lit(self.field).alias("field"), F.lit(self.message).alias("message"), F.lit(self.code).alias("code")))
        return F.when(F.coalesce(self.ok, F.lit(False)), F.array().cast(ERRORS)).otherwise(found)


def not_empty(field: str) -> Rule:
    return Rule(field, F.length(field) > 0, f"{field} must not be empty", "NOT_EMPTY")


def contains(field: str, part: str) -> Rule:
    return Rule(field, F.col(field).contains(part), f"{field} must contain {part}", "CONTAINS")


def in_range(field: str, low: object, high: object) -> Rule:
    return Rule(field, F.col(field).between(F.lit(low), F.lit(high)), f"{field} must be from {low} to {high}", "IN_RANGE")


def email(c: Column | str) -> Column:
    """Something before the first @, and a domain with a dot that isn't its last character."""
    x = F.col(c) if isinstance(c, str) else c
    at = F.locate("@", x)
    domain = x.substr(at + 1, F.length(x))
    return (at > 1) & domain.contains(".") & ~domain.endswith(".")


def is_email(field: str) -> Rule:
    return Rule(field, email(field), f"{field} must be an e-mail address", "EMAIL")


def min_length(field: str, n: int) -> Rule:
    """In bytes of UTF-8."""
    return Rule(field, F.octet_length(field) >= n, f"{field} must have at least {n} bytes", "MIN_LENGTH")


def max_length(field: str, n: int) -> Rule:
    return Rule(field, F.octet_length(field) <= n, f"{field} must have at most {n} bytes", "MAX_LENGTH")


def combined(rules: Sequence[Rule]) -> Column:
    """All errors of a row."""
    return F.concat(*(r.errors() for r in rules)) if rules else F.array().cast(ERRORS)


def with_errors(df: DataFrame, rules: Sequence[Rule], into: str = "errors") -> DataFrame:
    return df.withColumn(into, combined(rules))


def skip_invalid(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.where(F.size(combined(rules)) == 0)


def fail_fast(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows; the first invalid one ends the job when the plan runs."""
    found = combined(rules)
    checked = F.when(F.size(found) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid row: "), F.to_json(found))).cast("boolean"))
    return df.where(checked)


def validate(df: DataFrame, rules: Sequence[Rule], mode: str = "skip", record_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and a frame of record_id and errors of the others (empty unless mode is "log").

    mode: skip, log or fail.
    """
    if mode not in ("skip", "log", "fail"):
        raise ValueError(f"unknown mode {mode}")
    marked = with_errors(df, rules, "_errors")
    record = (F.col(record_id) if record_id else F.monotonically_increasing_id()).cast("string")
    errors = marked.where(F.size("_errors") > 0).select(record.alias("record_id"), F.col("_errors").alias("errors"))
    if mode == "fail":
        return fail_fast(df, rules), errors.limit(0)
    return marked.where(F.size("_errors") == 0).drop("_errors"), errors if mode == "log" else errors.limit(0)


def errors_to_json(errors: DataFrame, path: str) -> None:
    """The collected errors as JSON lines."""
    errors.write.mode("overwrite").json(path)
