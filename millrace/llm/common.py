"""Expressions shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the ASCII white space 0x20, 0x09-0x0D.
GAP = r"[\x20\x09-\x0D]+"
#: Ids that go to the tasks that read a table.
FEW = 1 << 22


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Inside a lambda an outer expression is evaluated for every element; a
    lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as array<string>; none for null or blank."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of every word, array<bigint>, computed in the JVM."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def crc32_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id as decimal text, modulo ``k`` (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` joined (left_semi or left_anti) with the ids of a staged frame's one column; up to ``FEW`` ids go to the texts, whatever the session broadcasts, not the texts to the ids."""
    id_ = ids.columns[0]
    few = ids.count() <= FEW
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col(id_), how)


def free(df: DataFrame, *names: str) -> list[str]:
    """A name like each of ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"_{name}"
        while own in taken:
            own = f"_{own}"
        taken.add(own)
        out.append(own)
    return out


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving freed memory back to the system when a task ends: a worker lives on with what it has once had."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole
