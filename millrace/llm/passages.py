"""Passages of at least ``min_words`` words that a document with a smaller id also holds.

A word goes when a window of ``min_words`` consecutive words covers it whose
word sequence also starts in a document with a smaller doc_id.  Two methods find
where matches can be, and extend them:

* "cover" (substring dedup): difference-cover anchors.  Short windows are hashed
  only where the position modulo the period is in a difference cover, so any two
  equal long windows, at any two positions, have an aligned pair of anchors inside.
  A shared anchor is extended to the left and right: to every long window around it.
* "suffix" (suffix-array dedup): a sparse suffix array.  Only suffixes that start at
  minimisers stay (every long window selects exactly one by its content); they are
  range-partitioned and sorted, and each is compared with its neighbours, which tells
  how far a match can reach to the right.  A suffix with an equal neighbour is extended
  to the left and right: to the long windows that select it, as far as the neighbours reach.

The words of an extension are compared by hash, 128 bits in all, and the smallest id with
the same extension decides.  For "suffix" the suffix's own hash is half of the key: its
windows meet those of equal suffixes only.

Scale: rows that move are (hash, id, position) of anchors, the texts that hold a shared one,
then one row for each candidate window.  The smallest id of each hash is aggregated with map-side
combine and written; the join back is an ordinary equi-join whose skewed partitions Spark
can split, so a hot window is not left to one task.  Exact copies are recognised by a
whole-document row, so their windows are not expanded.

Defined results: null text has no words; rows with a null id take no part and lose nothing; rows with the
same id are not smaller than each other; fewer words than ``min_words``: nothing goes; a document
without a repeat keeps its text to the character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free, tidy, word_hashes
from millrace.llm.rolling import Words, mixed, slices
from millrace.plans.staging import cut, discard

#: A perfect difference set: every residue modulo 31 is a difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of a suffix that its hash covers, and of each block after them.
HEAD, BLOCK, BLOCKS = 20, 5, 6


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("h"))


def _whole(ids: np.ndarray, w: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two rows for each document of ``least`` words or more: a hash of all its words, at positions -1 and -2."""
    docs = np.flatnonzero(w.lengths >= least)
    at, n = w.offsets[docs], w.lengths[docs]
    salt = n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    both = np.concatenate([mixed(w.window(at, n, 0) + salt), mixed(w.window(at, n, 1) + salt)])
    return both, np.tile(ids[docs], 2), np.repeat(np.array([-1, -2], np.int32), len(docs))


def cover_candidates(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, pos, reach of anchors that another document also holds (pos -1 and -2: a smaller document is the same); and the staged hashes."""
    width = min_words - PERIOD + 1
    cover = np.isin(np.arange(PERIOD), COVER)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, w in slices(batch.column(1)):
                at = np.flatnonzero(cover[w.pos % PERIOD] & (w.left >= width) & (w.lengths[w.doc] >= min_words))
                h, doc, pos = _whole(ids[a:b], w, min_words)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([mixed(w.window(at, width)), h]).view(np.int64)),
                    pa.array(np.concatenate([ids[a:b][w.doc[at]], doc])),
                    pa.array(np.concatenate([w.pos[at].astype(np.int32), pos])),
                ], names=["a", "doc_id", "pos"])

    rows = _hashed(docs).mapInArrow(tidy(anchors), "a bigint, doc_id bigint, pos int")
    shared = cut(rows.groupBy("a").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("a", "low"))
    return rows.join(shared, "a").where("pos >= 0 or low < doc_id").select("doc_id", "pos", F.lit(min_words).alias("reach")), shared


def _sliding(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """pick over x[i : i + width], for every i with a whole window."""
    step = 1
    while 2 * step <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x if step == width else pick(x[: len(x) - (width - step)], x[width - step :])


def selected(w: Words, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of k + span - 1 words, and the k-word window that each selects: the smallest hash among its ``span``, the leftmost of equal ones.

    Both are flat indices in ascending order.
    """
    starts = np.flatnonzero(w.left >= k + span - 1)
    if not len(starts):
        return starts, starts
    value = mixed(w.window(np.arange(len(w.flat) - k + 1), k))
    return starts, _sliding(np.arange(len(value)), span, lambda x, y: np.where(value[y] < value[x], y, x))[starts]


def suffix_candidates(docs: DataFrame, min_words: int, k: int = HEAD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Like cover_candidates, from neighbours in a sparse suffix array; and the staged suffixes.

    A suffix is stored as the hash of its first ``k`` words and six hashes of ``block`` words each, so that
    the sort needs no text and the common prefix of neighbours is known to within a block.
    """
    span, blocks = min_words - k + 1, BLOCKS

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, w in slices(batch.column(1)):
                at = np.unique(selected(w, k, span)[1])
                h, doc, pos = _whole(ids[a:b], w, min_words)
                pieces = []
                for i in range(blocks):
                    start = at + k + i * block
                    inside = w.left[at] >= k + (i + 1) * block
                    pieces.append(np.where(inside, mixed(w.window(np.where(inside, start, 0), block)) >> np.uint64(32), np.uint64(0)))
                packed = [np.concatenate([(pieces[i] << np.uint64(32)) | pieces[i + 1], np.zeros(len(h), np.uint64)]).view(np.int64) for i in range(0, blocks, 2)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([mixed(w.window(at, k)), h]).view(np.int64)), *map(pa.array, packed),
                    pa.array(np.concatenate([ids[a:b][w.doc[at]], doc])), pa.array(np.concatenate([w.pos[at].astype(np.int32), pos])),
                ], names=["a", "c0", "c1", "c2", "doc_id", "pos"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps a row whose neighbour before or after begins with the same k words; the first and last row of a partition stay too, as their neighbour is elsewhere."""
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            out, held, first = _compare(cols, k, block, first, False)
            yield out
        if held is not None:
            yield _compare(held, k, block, first, True)[0]

    order = ["a", "c0", "c1", "c2", "doc_id", "pos"]
    rows = cut(_hashed(docs).mapInArrow(tidy(suffixes), "a bigint, c0 bigint, c1 bigint, c2 bigint, doc_id bigint, pos int"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(neighbours), "doc_id bigint, pos int, reach int"), rows


def _compare(cols: list[np.ndarray], k: int, block: int, first: bool, last: bool) -> tuple[pa.RecordBatch, list[np.ndarray], bool]:
    """Judges all rows but the last two, which come again with the next batch (all, if ``last``)."""
    a, doc, pos = cols[0], cols[4], cols[5]
    n = len(a)
    same = a[1:] == a[:-1]
    reach, going = np.where(same, k, 0), same.copy()
    for c in cols[1:4]:
        x, y = c[1:].view(np.uint64), c[:-1].view(np.uint64)
        high = going & ((x >> np.uint64(32)) == (y >> np.uint64(32)))
        going = high & (x == y)
        reach = reach + block * (high.astype(np.int64) + going)
    both = np.zeros(n, np.int64)
    both[1:] = reach
    both[:-1] = np.maximum(both[:-1], reach)
    whole, before = pos < 0, np.zeros(n, bool)
    before[1:] = same & (doc[:-1] < doc[1:])
    for _ in range(2):  # rows of one id after the smaller one
        before[1:] |= same & before[:-1] & (doc[:-1] == doc[1:])
    keep = np.where(whole, before, both > 0)
    if first:
        keep[0] |= not whole[0]
        both[0] = k + 6 * block
    if last:
        keep[-1] |= not whole[-1]
        both[-1] = k + 6 * block
    # The row held over is judged once, when its right neighbour is there; the one before it goes along as its left neighbour.
    lo = 0 if first else 1
    hi = n if last else n - 1
    keep[:lo] = False
    keep[hi:] = False
    out = pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(pos[keep]), pa.array((both[keep] + block - 1).astype(np.int32))], names=["doc_id", "pos", "reach"])
    if n == 1:
        return out, cols, first
    return out, [c[-2:] for c in cols], False


def _listed(candidates: DataFrame) -> DataFrame:
    """A row for each document with candidates: x, y (1 if the rows at -1 and -2 are there) and ``near``, its anchors."""
    return cut(candidates.groupBy("doc_id").agg(
        F.max(F.when(F.col("pos") == -1, 1).otherwise(0)).alias("x"), F.max(F.when(F.col("pos") == -2, 1).otherwise(0)).alias("y"),
        F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "reach"))).alias("near")))


def _around(w: Words, row: np.ndarray, p: np.ndarray, r: np.ndarray, min_words: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat starts of the long windows that extend the anchors (row, p, reach r), and the first half of their keys."""
    if method == "cover":
        lo, hi = np.maximum(p - PERIOD + 1, 0), np.minimum(p, w.lengths[row] - min_words)
        ok = hi >= lo
        mark = np.zeros(len(w.flat) + 1, np.int64)
        np.add.at(mark, w.offsets[row[ok]] + lo[ok], 1)
        np.add.at(mark, w.offsets[row[ok]] + hi[ok] + 1, -1)
        at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        return at, w.window(at, min_words, 0)
    starts, chosen = selected(w, HEAD, min_words - HEAD + 1)
    near = w.offsets[row] + p
    order = np.lexsort((-r, near))  # repeated rows list an anchor twice; the longest reach counts
    near, r = near[order], r[order]
    if not len(near):
        return near, near.view(np.uint64)
    k = np.minimum(np.searchsorted(near, chosen), len(near) - 1)
    ok = (near[k] == chosen) & (starts + min_words <= chosen + r[k])
    return starts[ok], mixed(w.window(chosen[ok], HEAD))


def removed_windows(docs: DataFrame, listed: DataFrame, min_words: int, method: str) -> DataFrame:
    """doc_id, tx (hash of the text), whole, starts: what each document loses.

    ``whole``: the document is a copy of a smaller one.  ``starts``: first words of its repeated windows.
    """
    tx = F.xxhash64("text")
    several = docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_s")).agg(F.min(tx).alias("_low"), F.max(tx).alias("_high")).where("_low <> _high").select("_s")
    listed = listed.join(cut(several), F.col("doc_id") == F.col("_s"), "left").withColumn("whole", F.expr("x = 1 and y = 1 and _s is null"))  # of an id with different texts, another text may be the copy
    copies = listed.where("whole").select(F.col("doc_id").alias("_d"))
    near = listed.where("not whole and size(near) > 0").select(F.col("doc_id").alias("_d"), F.col("near")["pos"].alias("pos"), F.col("near")["reach"].alias("reach"))
    mine = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = mine.join(near, F.col("doc_id") == F.col("_d")).select("doc_id", F.xxhash64("text").alias("tx"), word_hashes(F.col("text")).alias("h"), "pos", "reach")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tx = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offsets = batch.column(3).offsets.to_numpy().astype(np.int64)
            pos, reach = (batch.column(i).values.to_numpy().astype(np.int64) for i in (3, 4))
            for a, b, w in slices(batch.column(2)):
                row = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
                at, key = _around(w, row, pos[offsets[a] : offsets[b]], reach[offsets[a] : offsets[b]], min_words, method)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(w.window(at, min_words, 1).view(np.int64)),
                    pa.array(ids[a:b][w.doc[at]]), pa.array(tx[a:b][w.doc[at]]), pa.array(w.pos[at].astype(np.int32)),
                ], names=["w1", "w2", "doc_id", "tx", "start"])

    rows = cut(joined.mapInArrow(tidy(windows), "w1 bigint, w2 bigint, doc_id bigint, tx bigint, start int"))
    low = cut(rows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"))
    gone = rows.join(low, ["w1", "w2"]).where("low < doc_id").groupBy("doc_id", "tx").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    whole = copies.select(F.col("_d").alias("doc_id"), F.lit(None).cast("long").alias("tx"), F.array().cast("array<int>").alias("starts"), F.lit(True).alias("whole"))
    lost = cut(gone.withColumn("whole", F.lit(False)).unionByName(whole))
    discard(rows)
    discard(low)
    return lost


def find_repeats(docs: DataFrame, method: str = "cover", min_words: int = 50) -> DataFrame:
    """What each document loses, by difference-cover anchors ("cover") or a sparse suffix array ("suffix")."""
    plain = docs.select("doc_id", "text")
    candidates, staged = (cover_candidates if method == "cover" else suffix_candidates)(plain, min_words)
    listed = _listed(candidates)
    discard(staged)
    lost = removed_windows(plain, listed, min_words, method)
    discard(listed)
    return lost


def _with_repeats(docs: DataFrame, lost: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, whose names are returned: starts of repeated windows, and whether all of the text goes."""
    d, tx, starts, whole = free(docs, "d", "tx", "starts", "whole")
    n = lost.select(F.col("doc_id").alias(d), F.col("tx").alias(tx), F.col("starts").alias(starts), F.col("whole").alias(whole))
    match = (F.col("doc_id").cast("long") == F.col(d)) & (F.col(whole) | (F.xxhash64(F.col("text")) == F.col(tx)))
    return docs.join(n, match, "left").drop(d, tx), starts, whole


def _covered(n: int, starts: np.ndarray, whole: bool, min_words: int) -> np.ndarray:
    if whole:
        return np.ones(n, bool)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + min_words, -1)
    return np.cumsum(mark[:-1]) > 0


def repeat_rows(docs: DataFrame, method: str, min_words: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    plain = docs.select("doc_id", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha = [], [], []
            for text, starts, whole in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                kept = (text.as_py() or "").encode().split()  # bytes split at ASCII white space only
                n_words.append(len(kept))
                if whole.as_py() or len(starts if starts.is_valid else ()):
                    gone = _covered(len(kept), np.asarray(starts.values.to_numpy(), np.int64), whole.as_py(), min_words)
                    kept = [w for w, x in zip(kept, gone.tolist(), strict=True) if not x]
                n_removed.append(n_words[-1] - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return _with_repeats(plain, find_repeats(docs, method, min_words))[0].mapInArrow(tidy(digest), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, method: str, min_words: int = 50) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (other characters stay) and ``n_chars``, where there is such a column, counted again."""

    def cut_out(texts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, starts, whole in texts:
            out = []
            for t, s, all_of_it in zip(text, starts, whole, strict=True):
                if t is not None and s is not None:
                    spans = [m.span() for m in WORD.finditer(t)]
                    gone = _covered(len(spans), np.asarray(s, np.int64), bool(all_of_it), min_words)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                    parts, last = [], 0
                    for i, j in zip(edge[::2], edge[1::2], strict=True):
                        parts.append(t[last : spans[i][0]])
                        last = spans[j - 1][1]
                    t = "".join([*parts, t[last:]])
                out.append(t)
            yield pd.Series(out, dtype=object)

    joined, starts, whole = _with_repeats(docs, find_repeats(docs, method, min_words))
    changed = F.col(starts).isNotNull()
    pruned = F.pandas_udf(cut_out, "string")(F.when(changed, F.col("text")), F.col(starts), F.col(whole))  # a Python function sees every row: unchanged ones as null
    out = joined.withColumn("text", F.when(changed, pruned).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
