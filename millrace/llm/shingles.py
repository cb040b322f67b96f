"""Sets of shingles: fingerprints, classes of equal sets, keys that similar sets share, exact similarity.

Keys: in one order of all shingles, two sets of Jaccard similarity t or more share a shingle among the first
n - ceil(t * n) + 1 of each.  Any order gives that; shingles that many classes hold come last, so that common passages
make few candidates.  Which ones these are is told by counts of each task's own shingles, summed over the tasks.
Keys that the same classes share are one.

Similarity: candidates are brought together in groups, each set once, and a group's links are found by counting the
shingles that its sets share; only links that connect are returned, so no pair of sets becomes a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import by_ids, tidy
from millrace.llm.rolling import mixed
from millrace.plans.staging import cut

#: Shingles that a task holds before it counts them, common ones that the driver and each task know at most.
HELD, COMMON = 1 << 22, 1 << 18
#: Shingles of a group's sets; larger groups are dealt into chunks, and every pair of chunks is a group.
GROUP = 1 << 20
#: Sets of a group that are compared before its largest component is chosen.
PROBES = 8
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``shingle`` words; of all words if there are fewer; none without words."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts words
    if not w:
        return np.empty(0, np.uint64)
    runs = zip(*(w[i:] for i in range(shingle)), strict=False) if len(w) >= shingle else (w,)
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, runs)), np.uint64)


def majority(h: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint as ``words`` 64-bit words; further words come from remixed hashes."""
    out = np.zeros(words, np.uint64)
    if not len(h):
        return out
    for k in range(words):
        x = h if k == 0 else (h ^ (h >> np.uint64(31))) * np.uint64(_MIX[k % 4] + 2 * k)
        x = x if k == 0 else x ^ (x >> np.uint64(29))
        counts = np.zeros(64, np.int64)
        for a in range(0, len(x), 1 << 16):
            counts += np.unpackbits(x[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(x), bitorder="little").view(np.uint64)[0]
    return out


def _set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def _class(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)



def classed(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, c (class), n (size of the set), f (fingerprint of 64 * ``words`` bits) of every row, as written; and rows with ``often`` and ``times`` alone: shingles that several classes of a task hold, and how many."""
    kind = dict(docs.dtypes)["doc_id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    names = ["doc_id", "c", "n", "f", "often", "times"]

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, k = np.unique(np.concatenate(held), return_counts=True)
        h, k = h[k > 1].view(np.int64), k[k > 1].astype(np.int32)
        for a in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int64())),
                pa.array([h[a : a + (1 << 16)]], pa.list_(pa.int64())), pa.array([k[a : a + (1 << 16)]], pa.list_(pa.int32())),
            ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            c, n, f = [], [], []
            for text in batch.column(1):
                h = _set(text.as_py(), shingle)
                c.append(_class(h))
                n.append(len(h))
                f.append(majority(h, words).view(np.int64))
                if c[-1] not in held:
                    held[c[-1]] = h
                    size += len(h)
                if size >= HELD:
                    yield from counted(list(held.values()))
                    held, size = {}, 0
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(f, pa.list_(pa.int64())), pa.nulls(len(c), pa.list_(pa.int64())), pa.nulls(len(c), pa.list_(pa.int32())),
            ], names=names)
        if held:
            yield from counted(list(held.values()))

    return cut(docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, c bigint, n int, f array<bigint>, often array<bigint>, times array<int>"))


def common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many classes hold, in ascending order, and how many; only the order of keys depends on it."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # explode copies the array for each of its elements
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), batch.column(1).flatten().cast(pa.int64())], names=["h", "k"])

    counts = cut(rows.where("often is not null").select("often", "times").mapInArrow(flat, "h bigint, k bigint").groupBy("h").agg(F.sum("k").alias("k")))
    level = F.floor(16 * F.log2("k")).cast("int")
    total, least = 0, 1 << 30
    for r in sorted(counts.groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # whole levels of frequency, from the top
        if total + r["n"] > COMMON:
            break
        total, least = total + r["n"], r["b"]
    found = counts.where(level >= least).toArrow()
    h, k = found.column("h").to_numpy().view(np.uint64), found.column("k").to_numpy()
    order = np.argsort(h)
    return h[order], k[order]


def keys(docs: DataFrame, shingle: int, similarity: float, late: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, c: the first shingles of each class's set, the common ones (``late``) last; a class comes once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        seen: set[int] = set()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                key, c = [np.zeros(0, np.uint64)], []
                for text in batch.column(0).slice(a, 512):
                    h = _set(text.as_py(), shingle)
                    if (own := _class(h)) in seen:
                        continue
                    seen.add(own)
                    first = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1 if len(h) else 0
                    if len(often):
                        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                        h = h[np.argsort(np.where(often[at] == h, times[at], 0), kind="stable")]
                    key.append(h[:first])
                    c.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.repeat(np.array(c, np.int64), [len(k) for k in key[1:]]))], names=["key", "c"])

    return docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(tidy(run), "key bigint, c bigint")


def shared_keys(docs: DataFrame, classes: DataFrame, shingle: int, similarity: float, late: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, id (class), n, f of the classes that share a key, as written; here a key is a hash of those classes, so keys that the same ones have are one."""

    def named(key: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (c[1:] != c[:-1])])
        key, c = key[new], c[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        name = mixed(np.add.reduceat(mixed(c.view(np.uint64)), start) + size.astype(np.uint64))
        own = np.repeat(size > 1, size)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[own].view(np.int64)), pa.array(c[own])], names=["key", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 2
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.concatenate([x, y.to_numpy()]) for x, y in zip(held, batch.columns, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the rows of the last key wait for the next batch
            if last:
                yield named(*(x[:last] for x in cols))
            held = [x[last:] for x in cols]
        if len(held[0]):
            yield named(*held)

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys(docs, shingle, similarity, late).repartition(tasks, "key").sortWithinPartitions("key", "c").mapInArrow(tidy(run), "key bigint, c bigint")
    return cut(rows.distinct().join(classes.select("c", "n", "f"), "c").select("key", F.col("c").alias("id"), "n", "f"))


def linked(flat: np.ndarray, n: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """i, j: links that connect what all pairs of the similarity would, among sets of ``n`` shingles each, one behind the other in ``flat``.

    Sets in the component of one of the first ``PROBES`` (the largest of them) aren't compared with each other any more.
    """
    m, off = len(n), np.concatenate([[0], np.cumsum(n)])
    _, token, df = np.unique(flat, return_inverse=True, return_counts=True)
    held = np.repeat(np.arange(m), n)[np.argsort(token, kind="stable")]  # the sets that hold each shingle
    start = np.cumsum(df) - df
    label, largest = np.arange(m), -1
    for i in range(m):
        if i == min(PROBES, m):
            largest = int(np.argmax(np.bincount(label, minlength=m)))
            largest = int(np.flatnonzero(label == largest)[0])
        if largest >= 0 and label[i] == label[largest]:
            continue
        t = token[off[i] : off[i + 1]]
        t = t[df[t] > 1]
        k = df[t]
        both = np.bincount(held[np.repeat(start[t] - (np.cumsum(k) - k), k) + np.arange(k.sum())], minlength=m)
        j = np.flatnonzero((both >= similarity * (n[i] + n - both) - 1e-9) & (label != label[i]))
        if len(j):
            others, at = np.unique(label[j], return_index=True)
            label[np.isin(label, others)] = label[i]
            yield i, j[at]


def confirmed(docs: DataFrame, classes: DataFrame, groups: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """u, v: classes of one group whose sets have the similarity, enough to connect them all.  groups: c, g."""
    members = cut(groups.join(classes.select("c", "n", "id"), "c"))
    large = members.groupBy("g").agg(F.ceil(F.sum("n") / GROUP).cast("long").alias("k")).where("k > 1")
    other = F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = members.join(large, "g", "left").withColumn("own", F.when(F.col("k").isNull(), 0).otherwise(F.pmod(F.xxhash64("c"), F.col("k")))).withColumn("other", other)
    dealt = dealt.select("id", "c", F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g"))
    used = cut(dealt.groupBy("id", "c").agg(F.collect_set("g").alias("g")).select(F.col("id").alias("_d"), "c", "g"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part, g, c, h = batch.slice(a, 512), [], [], []
                for text, own, to in zip(*part.columns, strict=True):
                    x = _set(text.as_py(), shingle)
                    if _class(x) == own.as_py():  # rows of one id may differ
                        for y in to.as_py():
                            g.append(y)
                            c.append(own.as_py())
                            h.append(x.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(h, pa.list_(pa.int64()))], names=["g", "c", "h"])

    def solve(parts: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        c = np.concatenate([x.column(1).to_numpy() for x in parts])
        n = np.concatenate([x.column(2).value_lengths().to_numpy() for x in parts]).astype(np.int64)
        flat = np.concatenate([x.column(2).flatten().to_numpy() for x in parts])
        new = np.concatenate([[True], c[1:] != c[:-1]])
        flat, n, c = flat[np.repeat(new, n)], n[new], c[new]
        for i, j in linked(flat, n, similarity):
            yield np.repeat(c[i], len(j)), c[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            g, out = batch.column(0).to_numpy(), []
            for a, b in pairwise([0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else []):
                if held and held[0].column(0)[0].as_py() != g[a]:
                    out += solve(held)
                    held = []
                held.append(batch.slice(a, b - a))
            for u, v in out:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        for u, v in solve(held) if held else []:
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = by_ids(docs.select("doc_id", "text"), used.select("_d"), "left_semi")
    rows = texts.join(used, F.col("doc_id") == F.col("_d")).select("text", "c", "g").mapInArrow(tidy(sets), "g bigint, c bigint, h array<bigint>")
    return cut(rows.repartition(tasks, "g").sortWithinPartitions("g", "c").mapInArrow(tidy(run), "u bigint, v bigint"))
