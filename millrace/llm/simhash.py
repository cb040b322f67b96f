"""SimHash near-duplicates with bit-sliced comparison.

1. A document's fingerprint has ``bits`` bits; a bit is set if over half the
   hashes of its word shingles have it.  Equal fingerprints become one row.
2. Each distinct fingerprint gets keys, so that near ones share a bucket.
   ``exact_masks``: the bits are cut into radius + 2 blocks and every choice of
   blocks that two fingerprints within the radius must share is a key, so no
   link is lost.
3. Rows are sorted by key and compared bit-sliced: plane b holds bit b of 64
   rows in each word.  For a distance d in the sort order, plane XOR shifted
   plane gives the differing bits of 64 pairs at once; carry-save adders sum
   planes into bitwise counters, and the block is abandoned once every pair is
   beyond the radius.  Only a spanning forest of each bucket's links is returned.
4. Connected components, written and reread between rounds.

``one_of_each`` does the same with the sets of five-word shingles behind the fingerprints: rows
share a key if their sets can be similar, and the bit-sliced comparison of 256 bits connects candidates to groups.
Each set goes to its group once, where the links are found by the exact Jaccard similarity.

Buckets of more than ``CHUNK`` rows are dealt into chunks and every pair of
chunks becomes a group of its own, so a hot bucket is neither cut short nor left
to one task.

Defined results: null or blank text has the zero fingerprint, linked like any other; rows
with a null id get a fingerprint and no component; rows with the same id share the component of the smallest.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import by_ids, free, tidy
from millrace.llm.components import components
from millrace.llm.shingles import classed, common, confirmed, majority, shared_keys, shingle_hashes
from millrace.plans.staging import cut, discard

CHUNK = 8192


def fingerprints(docs: DataFrame, shingle: int = 5, bits: int = 64) -> DataFrame:
    """doc_id and f, the fingerprint as array<bigint>, of every row."""
    n = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.concatenate([np.zeros(0, np.uint64), *(majority(shingle_hashes(t.as_py(), shingle), n) for t in batch.column(1))])
            f = pa.ListArray.from_arrays(pa.array(np.arange(0, len(f) + 1, n, dtype=np.int32)), pa.array(f.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), f], names=["doc_id", "f"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, f array<bigint>")


def exact_masks(bits: int, radius: int) -> list[np.ndarray]:
    """Bit positions of each key: any two fingerprints within ``radius`` agree on one of them entirely."""
    blocks = np.array_split(np.arange(bits), radius + 2)
    return [np.concatenate(c) for c in itertools.combinations(blocks, 2)]


def _keys(f: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key for each row (axis 0) and mask (axis 1)."""
    bits = np.unpackbits(f.view(np.uint8).reshape(len(f), -1), axis=1, bitorder="little")
    out = np.empty((len(f), len(masks)), np.uint64)
    for t, m in enumerate(masks):
        packed = np.packbits(bits[:, m], axis=1, bitorder="little")
        key = np.full(len(f), (t + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for j in range(packed.shape[1]):
            key = (key ^ packed[:, j].astype(np.uint64)) * np.uint64(0x100000001B3)
        out[:, t] = key ^ (key >> np.uint64(32))
    return out


def _shift(plane: np.ndarray, d: int) -> np.ndarray:
    """The plane with row i + d in the place of row i."""
    q, r = divmod(d, 64)
    out = np.zeros_like(plane)
    out[..., : plane.shape[-1] - q] = plane[..., q:]
    if r:
        low = out >> np.uint64(r)
        low[..., :-1] |= out[..., 1:] << np.uint64(64 - r)
        return low
    return out


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the bitwise counters exceed the radius."""
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
    for j in range(len(counters) - 1, -1, -1):
        if radius >> j & 1:
            equal &= counters[j]
        else:
            more |= equal & counters[j]
            equal &= ~counters[j]
    return more


def bit_sliced_pairs(f: np.ndarray, group: np.ndarray, radius: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius among rows of equal, consecutive ``group``, one distance in the order after another.

    With ``label``, which the caller may change on the way, pairs of equal label are left out.
    """
    n = len(f)
    if n < 2:
        return
    size = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), [n]]))
    bits = np.unpackbits(f.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    pad = -n % 64
    turned = np.packbits(np.concatenate([bits, np.zeros((pad, bits.shape[1]), np.uint8)]).T, axis=1, bitorder="little")
    planes = np.ascontiguousarray(turned).view(np.uint64)
    levels = max(radius.bit_length() + 1, 2)
    for d in range(1, int(size.max())):
        same = np.zeros(n + pad, np.uint8)
        same[: n - d] = group[d:] == group[:-d] if label is None else (group[d:] == group[:-d]) & (label[d:] != label[:-d])
        alive = np.packbits(same, bitorder="little").view(np.uint64)
        words = np.flatnonzero(alive)
        if not len(words):
            continue
        alive, a = alive[words], 0
        counters = [np.zeros(len(words), np.uint64) for _ in range(levels)]
        full = np.zeros(len(words), np.uint64)
        q, r = divmod(d, 64)
        lo = np.minimum(words + q, planes.shape[1] - 1)
        hi = np.minimum(words + q + 1, planes.shape[1] - 1)
        while a < len(planes) and alive.any():
            for _ in range(4):  # 12 planes between checks
                x = []
                for p in planes[a : a + 3]:
                    moved = p[lo] >> np.uint64(r) | (p[hi] << np.uint64(64 - r) if r else np.uint64(0))
                    x.append(p[words] ^ moved)
                a += 3
                if not x:
                    break
                if len(x) == 3:  # a carry-save adder: three planes in, one of weight 1 and one of weight 2 out
                    half = x[0] ^ x[1]
                    x = [(half ^ x[2], 0), (x[0] & x[1] | half & x[2], 1)]
                else:
                    x = [(y, 0) for y in x]
                for carry, j in x:
                    while j < levels:
                        counters[j], carry = counters[j] ^ carry, counters[j] & carry
                        j += 1
                    full |= carry
            alive &= ~(full | _beyond(counters, radius))
        if alive.any():
            local = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
            i = words[local // 64] * 64 + local % 64
            yield i, i + d


def _sized(n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sizes of two sets allow the similarity."""
    return np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9


def _forest(f: np.ndarray, group: np.ndarray, radius: int, n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what bit_sliced_pairs connects, fewer than there are rows."""
    label = np.arange(len(f))
    us, vs = [], []
    for i, j in bit_sliced_pairs(f, group, radius, label):  # rows that are connected by now aren't compared again
        changed, ok = False, _sized(n, i, j, similarity)
        for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            x, y = a, b
            while label[x] != x:
                x = label[x]
            while label[y] != y:
                y = label[y]
            if x != y:
                label[max(x, y)] = min(x, y)
                us.append(a)
                vs.append(b)
                changed = True
        while changed:
            flat = label[label]
            changed = not np.array_equal(flat, label)
            label[:] = flat
    return np.array(us, np.int64), np.array(vs, np.int64)


def compared(rows: DataFrame, radius: int, similarity: float = 0.0) -> DataFrame:
    """u, v: ids that share a key, whose fingerprints are within the radius and whose set sizes allow the similarity, enough to connect in each bucket what all would connect.

    rows: key, id, f, n (size of the set).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def solve(key: np.ndarray, ids: np.ndarray, f: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.repeat(np.diff(np.concatenate([start, [len(key)]])), np.diff(np.concatenate([start, [len(key)]])))
            for low, high in ((2, 16), (16, 128), (128, 1 << 62)):
                own = np.flatnonzero((size >= low) & (size < high))
                if len(own):
                    u, v = _forest(np.ascontiguousarray(f[own]), key[own], radius, n[own], similarity)
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[own][u]), pa.array(ids[own][v])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1), batch.column(3).to_numpy()]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the rows of the last key wait for the next batch
            yield from solve(*(c[:last] for c in cols))
            held = [c[last:] for c in cols]
        if held is not None:
            yield from solve(*held)

    hot = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CHUNK))
    if not hot.isEmpty():
        g = F.ceil(F.col("k") / (CHUNK // 2)).cast("long")
        own = F.pmod(F.xxhash64("id"), F.col("g"))
        rows = (
            rows.join(hot.select("key", g.alias("g")), "key", "left").withColumn("c", own)
            .withColumn("other", F.explode(F.when(F.col("g").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))))
            .withColumn("key", F.when(F.col("g").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("c", "other"), F.greatest("c", "other"))))
        )
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    return rows.select("key", "id", "f", "n").repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(tidy(run), "u bigint, v bigint")


def links(classes: DataFrame, radius: int, masks: list[np.ndarray]) -> DataFrame:
    """u, v: ids of distinct fingerprints within the radius, enough to connect them all."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                ids, n = part.column(0).to_numpy(), part.num_rows
                f = part.column(1).flatten().to_numpy().view(np.uint64).reshape(n, -1)
                key = _keys(f, masks).reshape(-1)
                flat = np.repeat(f, len(masks), axis=0).reshape(-1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(np.repeat(ids, len(masks))),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, f.shape[1], dtype=np.int32)), pa.array(flat.view(np.int64))),
                ], names=["key", "id", "f"])

    rows = classes.select("id", "f").mapInArrow(tidy(keyed), "key bigint, id bigint, f array<bigint>")
    return compared(rows.select("*", F.lit(0).alias("n")), radius)


def grouped(prints: DataFrame, radius: int) -> DataFrame:
    """``prints`` (doc_id, f, as written) with component_id, the smallest doc_id that links reach; no link within the radius is lost."""
    classes = cut(prints.where(F.col("doc_id").isNotNull()).groupBy("f").agg(F.min("doc_id").cast("long").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "f"))
    first = classes.first()
    if first is None:
        return prints.withColumn("component_id", F.col("doc_id").cast("long"))
    root = components(links(classes, radius, exact_masks(64 * len(first["f"]), radius)))
    named = classes.join(root, classes["id"] == root["u"], "left").select(F.col("f").alias("_f"), F.coalesce("v", "id").alias("component_id"))
    return prints.join(named, (prints["f"] == named["_f"]) & prints["doc_id"].isNotNull(), "left").drop("_f")


def simhash_rows(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    prints = cut(fingerprints(docs, shingle))
    return grouped(prints, radius).select("doc_id", F.lpad(F.lower(F.hex(F.col("f")[0])), 16, "0").alias("fingerprint"), "component_id")


def radius_of(similarity: float, bits: int) -> int:
    """Differing bits that sets of the similarity stay below: five standard deviations above what is expected of large sets and of the worst small ones (4 and 5 shingles: 3/16)."""
    share = max(math.acos(2 * similarity / (1 + similarity)) / math.pi, 3 / 16)
    return math.ceil(bits * share + 5 * math.sqrt(bits * share * (1 - share)))


def similar(docs: DataFrame, classes: DataFrame, late: tuple[np.ndarray, np.ndarray], shingle: int, similarity: float, bits: int) -> DataFrame:
    """u, v: classes whose shingle sets have the similarity, enough to connect them all.

    Fingerprints of rows that share a key are compared bit-sliced; what the candidates connect is a group, which all links of its classes are inside.
    """
    rows = shared_keys(docs, classes, shingle, similarity, late)
    near = components(compared(rows, radius_of(similarity, bits), similarity))
    discard(rows)
    groups = near.select(F.col("u").alias("c"), F.col("v").alias("g")).unionByName(near.select(F.col("v").alias("c"), F.col("v").alias("g")).distinct())
    return confirmed(docs, classes, groups, shingle, similarity)


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 256) -> DataFrame:
    """``docs`` without near copies (Jaccard similarity of shingle sets): of each component the row with the smallest doc_id stays (of equal ids, one row).

    Null and blank texts have the empty set and are copies of each other.  Rows with a null id all stay.
    """
    rows = classed(docs, shingle, bits // 64)
    prints = rows.where("often is null").drop("often", "times")
    classes = cut(prints.where("doc_id is not null").groupBy("c").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min("f").alias("f")))
    root = components(similar(docs, classes, common(rows), shingle, similarity, bits))
    d, n = free(docs, "d", "n")
    stay = classes.join(root, classes["c"] == root["u"], "left").groupBy(F.coalesce("v", "c").alias("g")).agg(F.min("id").alias(d)).select(d).distinct()
    counts = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias(n))
    gone = cut(counts.where("doc_id is not null").select(F.col("doc_id").alias(d)).join(stay, d, "left_anti"))
    kept = by_ids(docs.where(F.col("doc_id").isNotNull()), gone, "left_anti")
    repeated = counts.where(F.col("doc_id").isNotNull() & (F.col(n) > 1)).select(F.col("doc_id").alias(d))
    if not repeated.isEmpty():
        same = F.col("doc_id") == F.col(d)
        kept = kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id"]))
    if not counts.where(F.col("doc_id").isNull()).isEmpty():
        kept = kept.unionByName(docs.where(F.col("doc_id").isNull()))
    return kept
