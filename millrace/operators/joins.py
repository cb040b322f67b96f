"""Equi-joins in which null keys equal each other, N-way co-grouping, and side inputs.

Spark chooses the physical join; a side input is broadcast only after its size has been checked.  Keys that many rows of both
sides share (nulls, often) make their product of rows; they are counted first and their products are dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of either side in one cell of a large key's product; a task holds one cell at a time.
CELL_ROWS = 512

#: Rows up to which a side input is broadcast; larger ones join as any other table.
SIDE_ROWS = 100_000


def _unused(name: str, *frames: DataFrame) -> str:
    """The name, with as many underscores before it as no column has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column, dict[str, str]]:
    own = {k: _unused(f"_r_{k.lower()}", left, right) for k in keys}
    renamed = right.withColumnsRenamed(own)
    return renamed, reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[own[k]]) for k in keys)), own


def _counted(left: DataFrame, right: DataFrame, how: str) -> bool:
    """Whether keys can be counted before the join: not if Spark broadcasts a side, nor if frames are streams or not the same when read again."""
    limit = left.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    plans = [f._jdf.queryExecution().optimizedPlan() for f in (left, right)]
    small = [int(str(p.stats().sizeInBytes())) <= limit for p in plans]
    return not (small[1] and how in ("inner", "left") or small[0] and how in ("inner", "right") or left.isStreaming or right.isStreaming) and all(p.deterministic() for p in plans)


def _same_when_compared(a: T.DataType, b: T.DataType) -> bool:
    return a == b or isinstance(a, T.NumericType) and isinstance(b, T.NumericType)


def _large_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """k0, k1 and so on, l and r: keys that make more pairs than a cell holds, with their chunks on either side; few, since each makes so many rows."""
    ones = [f.select(*(f[k].alias(f"k{i}") for i, k in enumerate(keys)), F.lit(n).alias("l"), F.lit(1 - n).alias("r")) for f, n in ((left, 1), (right, 0))]
    chunks = (F.ceil(F.col(c) / CELL_ROWS).alias(c) for c in ("l", "r"))
    counts = ones[0].union(ones[1]).groupBy(*(f"k{i}" for i in range(len(keys)))).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    found = counts.where(F.col("l") * F.col("r").cast("double") > CELL_ROWS**2).select(*(f"k{i}" for i in range(len(keys))), *chunks)
    rows = found._jdf.collectAsList()  # stays in the JVM: times and the like are the same afterwards
    return DataFrame(left.sparkSession._jsparkSession.createDataFrame(rows, found._jdf.schema()), left.sparkSession) if rows.size() else None


def _dealt(frame: DataFrame, keys: Sequence[str], large: DataFrame, cell: str, is_left: bool) -> DataFrame:
    """Each row of a large key with the cells of its chunk, which its checksum chooses; the other rows once, with cell -1."""
    fits = [frame[f.name] for f in frame.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    own, other = (large["l"], large["r"]) if is_left else (large["r"], large["l"])
    chunk = F.pmod(F.xxhash64(*fits), own)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), other - 1), (lambda j: chunk * large["r"] + j) if is_left else (lambda i: i * large["r"] + chunk))
    on = reduce(lambda a, b: a & b, (frame[k].eqNullSafe(large[f"k{i}"]) for i, k in enumerate(keys)))
    return frame.join(F.broadcast(large), on, "left").select(*(frame[c] for c in frame.columns), F.explode(F.coalesce(cells, F.array(F.lit(-1).cast("long")))).alias(cell))


def join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner", deal: bool = True) -> DataFrame:
    """Key columns once, then the other columns of both; columns of a side without a match are null.

    how: inner, left, right or full.  deal: unless Spark broadcasts a side, count the rows of each key and deal the products of
    large ones over the tasks; the copies this takes are at most 1/256 of the rows that come out.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    clash = (set(left.columns) & set(right.columns)) - set(names)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}; rename them first")
    others = [c for c in left.columns if c not in names], [c for c in right.columns if c not in names]
    there = _unused("_r", left, right)
    right = right.withColumn(there, F.lit(True))
    large = None
    if deal and all(_same_when_compared(left.schema[k].dataType, right.schema[k].dataType) for k in names) and _counted(left, right, how):
        large = _large_keys(left, right, names)
    if large is not None:
        lcell, rcell = _unused("_lc", left, right), _unused("_rc", left, right)
        left, right = _dealt(left, names, large, lcell, True), _dealt(right, names, large, rcell, False)
    renamed, on, own = _on(left, right, names)
    if large is None:
        both = left.join(renamed, on, how)
    else:  # a row of a large key that meets an empty chunk has its partners in other cells
        l, r = left[lcell], renamed[rcell]  # noqa: E741
        both = left.join(renamed, on & (l == r), how).where((F.coalesce(l, r) < 0) | l.isNotNull() & r.isNotNull())
    key = {"inner": lambda k: left[k], "left": lambda k: left[k], "right": lambda k: renamed[own[k]]}.get(how, lambda k: F.when(renamed[there].isNotNull(), renamed[own[k]]).otherwise(left[k]))
    return both.select(*(key(k).alias(k) for k in names), *(left[c] for c in others[0]), *(renamed[c] for c in others[1]))


def join_inner(left: DataFrame, right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    return join(left, right, keys, "inner")


def join_left(left: DataFrame, right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    return join(left, right, keys, "left")


def join_right(left: DataFrame, right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    return join(left, right, keys, "right")


def join_full(left: DataFrame, right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    return join(left, right, keys, "full")


def cogroup(keys: str | Sequence[str], **inputs: DataFrame) -> DataFrame:
    """A row for each key of any input, with an array of the other columns (as structs) from each; empty where an input lacks the key."""
    names = [keys] if isinstance(keys, str) else list(keys)
    tagged = []
    for tag, df in inputs.items():
        rest = [c for c in df.columns if c not in names]
        tagged.append(df.select(*names, *(F.struct(*(rest or [F.lit(True).alias("present")])).alias(t) if t == tag else F.lit(None).alias(t) for t in inputs)))
    kinds = {tag: frame.schema[tag].dataType for tag, frame in zip(inputs, tagged, strict=True)}
    same = [frame.select(*names, *(F.col(t).cast(kinds[t]).alias(t) for t in inputs)) for frame in tagged]
    union = reduce(DataFrame.unionByName, same)
    return union.groupBy(*names).agg(*(F.collect_list(t).alias(t) for t in inputs))


def side(df: DataFrame, limit: int = SIDE_ROWS) -> DataFrame:
    """Marks a side input for broadcast if it has at most ``limit`` rows; a larger one stays an ordinary table."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def side_map(df: DataFrame, key: str, order_by: str) -> DataFrame:
    """One row for each key: the last one in ``order_by``."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order_by).alias("_v")).select(key, "_v.*")


def side_multimap(df: DataFrame, key: str, into: str = "values") -> DataFrame:
    """One row for each key with an array of its rows."""
    return df.groupBy(key).agg(F.collect_list(F.struct(*(c for c in df.columns if c != key))).alias(into))


def side_singleton(df: DataFrame, column: str) -> Column:
    """The one value of a one-row frame as a literal."""
    rows = df.select(column).take(2)
    if len(rows) != 1:
        raise ValueError("a singleton has exactly one row")
    return F.lit(rows[0][0])


def map_with_side(df: DataFrame, other: DataFrame, key: str, fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows with the side input's columns of their key, null where it has none."""
    there = side(other)
    joined = join(df, there, key, "left", deal=there is other)
    return fn(joined) if fn else joined


def filter_with_side(df: DataFrame, other: DataFrame, key: str, present: bool = True) -> DataFrame:
    """Rows whose key is (or isn't) among the side input's."""
    renamed, on, _ = _on(df, side(other.select(key).distinct()), [key])
    return df.join(renamed, on, "left_semi" if present else "left_anti")


def map_with_singleton(df: DataFrame, value: Column, fn: Callable[[DataFrame, Column], DataFrame]) -> DataFrame:
    return fn(df, value)


def filter_with_singleton(df: DataFrame, value: Column, test: Callable[[Column], Column]) -> DataFrame:
    return df.where(test(value))


def map_with_side_multimap(df: DataFrame, other: DataFrame, key: str, into: str = "values") -> DataFrame:
    """Rows with the array of the side input's rows of their key, empty where it has none."""
    grouped = side_multimap(other, key, into)
    there = side(grouped)
    joined = join(df, there, key, "left", deal=there is grouped)
    return joined.withColumn(into, F.coalesce(F.col(into), F.array().cast(grouped.schema[into].dataType)))


def filter_with_side_multimap(df: DataFrame, other: DataFrame, key: str, test: Callable[[Column], Column], into: str = "values") -> DataFrame:
    return map_with_side_multimap(df, other, key, into).where(test(F.col(into))).drop(into)
