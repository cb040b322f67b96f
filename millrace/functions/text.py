"""Regular-expression operators over a text column.

Patterns use Java's dialect.  Look-around and back-references are refused, so that every pattern also runs on linear-time engines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REFUSED = re.compile(r"\(\?(?:[=!]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]|\\k<")


def checked(pattern: str) -> str:
    if _REFUSED.search(pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern}")
    return pattern


def matches(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows with a match anywhere."""
    return df.where(F.col(column).rlike(checked(pattern)))


def group_of(column: Column | str, pattern: str, group: int) -> Column:
    """A group of the first match; null without a match or where the group took no part in it."""
    c = F.col(column) if isinstance(column, str) else column
    found = F.regexp_extract(c, checked(pattern), group)
    present = c.rlike(pattern)
    if group and _optional(pattern, group):
        present &= F.length(found) > 0  # Spark writes an absent group as the empty text
    return F.when(present, found)


def _optional(pattern: str, group: int) -> bool:
    """Whether group ``group`` may take no part in a match: it or one around it is optional, or an alternative."""
    depth_open: list[tuple[int, int]] = []
    number, i, spans = 0, 0, {}
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "[":
            i += 1
            while i < len(pattern) and (pattern[i] != "]" or pattern[i - 1] == "["):
                i += 2 if pattern[i] == "\\" else 1
        elif ch == "(":
            capturing = pattern[i + 1 : i + 2] != "?" or pattern[i + 1 : i + 3] in ("?<", "?P")
            number += capturing
            depth_open.append((number if capturing else 0, i))
        elif ch == ")" and depth_open:
            n, a = depth_open.pop()
            spans[(n, a)] = i
        i += 1
    own = next(((a, b) for (n, a), b in spans.items() if n == group), None)
    if own is None:
        return False
    around = [(a, b) for (_, a), b in spans.items() if a <= own[0] and b >= own[1]]
    if any(pattern[b + 1 : b + 2] in ("?", "*") or pattern[b + 1 : b + 3] in ("{0",) for _, b in around):
        return True
    outer = [(-1, len(pattern)), *((a, b) for a, b in around if (a, b) != own)]
    for a, b in outer:
        depth, j = 0, a + 1
        while j < b:
            if pattern[j] == "\\":
                j += 2
                continue
            depth += (pattern[j] == "(") - (pattern[j] == ")")
            if pattern[j] == "|" and depth == 0:
                return True
            j += 1
    return False


def extract(df: DataFrame, column: str, pattern: str, group: int = 1, into: str = "value") -> DataFrame:
    """A group of the first match; rows without it go."""
    return df.select(group_of(column, pattern, group).alias(into)).where(F.col(into).isNotNull())


def extract_pairs(df: DataFrame, column: str, pattern: str, key_group: int = 1, value_group: int = 2) -> DataFrame:
    """key and value from two groups of the first match; rows that lack either go."""
    pairs = df.select(group_of(column, pattern, key_group).alias("key"), group_of(column, pattern, value_group).alias("value"))
    return pairs.where(F.col("key").isNotNull() & F.col("value").isNotNull())


def find(df: DataFrame, column: str, pattern: str, into: str = "value") -> DataFrame:
    """The first whole match; rows without one go."""
    return df.select(F.regexp_substr(column, F.lit(checked(pattern))).alias(into)).where(F.col(into).isNotNull())


def replace_all(df: DataFrame, column: str, pattern: str, replacement: str, into: str | None = None) -> DataFrame:
    """Every match replaced; $1 and ${name} stand for groups."""
    return df.withColumn(into or column, F.regexp_replace(column, checked(pattern), replacement))


def split(df: DataFrame, column: str, pattern: str, into: str = "value") -> DataFrame:
    """A row for each field, empty ones too."""
    return df.select(F.explode(F.split(column, checked(pattern), -1)).alias(into))
