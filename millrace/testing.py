"""Assertions, builders and fixtures for tests of pipelines."""

from __future__ import annotations

import csv
import json
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def _plain(x: object) -> object:
    if isinstance(x, Row):
        return tuple(_plain(v) for v in x)
    if isinstance(x, list | tuple):
        return tuple(_plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _plain(v)) for k, v in x.items()))
    return x


def rows(df: DataFrame) -> list[tuple]:
    return [_plain(r) for r in df.collect()]


def assert_equal(df: DataFrame, expected: Iterable) -> None:
    """Same rows in the same order."""
    got, want = rows(df), [_plain(r) for r in expected]
    assert got == want, f"{got} != {want}"


def assert_same(df: DataFrame, expected: Iterable) -> None:
    """Same rows, each as often, in any order."""
    got, want = Counter(rows(df)), Counter(_plain(r) for r in expected)
    assert got == want, f"extra {got - want}, missing {want - got}"


def assert_grouped(df: DataFrame, expected: dict) -> None:
    """key and array of values, the values in any order."""
    got = {_plain(k): Counter(_plain(v)) for k, v in df.collect()}
    assert got == {_plain(k): Counter(map(_plain, v)) for k, v in expected.items()}, got


def assert_map(df: DataFrame, expected: dict) -> None:
    assert dict(rows(df)) == expected, rows(df)


def assert_all(df: DataFrame, test: Column) -> None:
    assert df.where(~F.coalesce(test, F.lit(False))).isEmpty(), "some row fails the test"


def assert_any(df: DataFrame, test: Column) -> None:
    assert not df.where(test).isEmpty(), "no row passes the test"


def assert_none(df: DataFrame, test: Column) -> None:
    assert df.where(test).isEmpty(), "some row passes the test"


def assert_size(df: DataFrame, n: int) -> None:
    assert (got := df.count()) == n, f"{got} rows, not {n}"


def assert_empty(df: DataFrame) -> None:
    assert df.isEmpty(), "there are rows"


def assert_contains(df: DataFrame, *expected: Sequence) -> None:
    got = set(rows(df))
    missing = [r for r in map(_plain, expected) if r not in got]
    assert not missing, f"missing {missing}"


@dataclass
class Builder:
    """Rows for a test, added step by step."""

    rows: list = field(default_factory=list)

    def add(self, *values: object) -> Builder:
        self.rows.extend(values)
        return self

    def repeat(self, value: object, n: int) -> Builder:
        self.rows.extend([value] * n)
        return self

    def span(self, start: int, end: int) -> Builder:
        self.rows.extend(range(start, end))
        return self

    def frame(self, spark: SparkSession, schema: str) -> DataFrame:
        return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in self.rows], schema)


@dataclass
class KeyedBuilder(Builder):
    def add_key(self, key: object, *values: object) -> KeyedBuilder:
        self.rows.extend((key, v) for v in values)
        return self


def sequential(n: int) -> list[int]:
    return list(range(n))


def sequential_pairs(n: int, keys: int) -> list[tuple[str, int]]:
    return [(f"key{i % keys}", i) for i in range(n)]


def skewed_pairs(n: int) -> list[tuple[str, int]]:
    """Half of the rows have one key, a tenth share some, the rest have keys of their own."""
    return [("hot" if i < n // 2 else f"warm{i % 3}" if i < n * 6 // 10 else f"cold{i}", i) for i in range(n)]


def pseudo_random(n: int, seed: int = 12345, below: int = 1000) -> list[int]:
    """A linear congruential sequence."""
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(x % below)
    return out


def pseudo_random_pairs(n: int, keys: int, seed: int = 54321) -> list[tuple[str, int]]:
    draw = pseudo_random(2 * n, seed, 1 << 30)
    return [(f"key{a % keys}", b % 1000) for a, b in zip(draw[::2], draw[1::2], strict=True)]


def log_entries() -> list[tuple]:
    """timestamp, ip, method, path, status, bytes."""
    paths = ("/", "/login", "/api/items", "/missing")
    return [(1_700_000_000 + 60 * i, f"10.0.0.{i % 5}", "POST" if i % 4 == 1 else "GET", paths[i % 4], 404 if i % 4 == 3 else 200, 100 * i) for i in range(20)]


def numbers_with_outliers() -> list[float]:
    return [10.0 + (i % 7) / 2 for i in range(30)] + [150.0, -50.0]


def time_series() -> list[tuple[int, float]]:
    return [(t, float((t - 1000) // 100)) for t in range(1000, 2001, 100)]


def debug(df: DataFrame, name: str = "", n: int = 5, write: Callable[[str], None] = print) -> DataFrame:
    """Writes the size and a few rows now, and passes the frame on."""
    write(f"{name}: {df.count()} rows; {[tuple(r) for r in df.limit(n).collect()]}")
    return df


def csv_file(path, header: Sequence[str], lines: Iterable[Sequence]) -> str:
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(lines)
    return str(path)


def jsonl_file(path, records: Iterable[dict]) -> str:
    with open(path, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)
    return str(path)


def assert_jsonl(path, expected: Iterable[dict]) -> None:
    with open(path) as f:
        assert [json.loads(x) for x in f if x.strip()] == list(expected)


def assert_csv(path, expected: Iterable[Sequence[str]]) -> None:
    with open(path, newline="") as f:
        assert [tuple(r) for r in csv.reader(f)] == [tuple(r) for r in expected]
