"""Exact top-k search by inner product with a pivot table.

Vectors are integers, floor(scale * x).  With one more coordinate, sqrt(M^2 - |x|^2) for candidates and 0 for
queries (M: the largest norm), a larger inner product is a smaller distance, so the triangle inequality holds:
|d(q, p) - d(x, p)| <= d(q, x) for every pivot p.  The distances of all candidates to the pivots are computed once;
their maximum over the pivots bounds each pair from below, and so its score from above.

Candidates are dealt into blocks by their nearest pivot, queries likewise.  A first k-th score of each query comes from the sampled
rows that the pivots were chosen from.  Three eliminations follow, each by the intervals that distances to the pivots span:

1. pairs of a query block and a candidate block, before any vector moves;
2. in a task, pairs of a query and 64 candidates that are close to each other: they are evaluated, as matrix products, in the order of their bound;
3. a query is done when its next bound can't reach its k-th score: exact, ties included.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no part; vectors
meet only those of their own length; rows that share the query's id are its own; repeated candidates count each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.common import tidy
from millrace.plans.staging import cut

BLOCK, QUERIES, PIVOTS, SAMPLE = 4096, 512, 32, 2048
#: Vector lengths with pivots, the most frequent ones; vectors of other lengths are bounded by norms alone.
LENGTHS = 100
#: Candidates that are eliminated together.
TOGETHER = 64


def integers(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array<bigint>), dim of the rows that take part."""
    x = F.col(vector)
    bad = lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf"))
    usable = F.col(key).isNotNull() & x.isNotNull() & ~F.coalesce(F.exists(x, bad), F.lit(True))
    return vectors.where(usable).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"), F.size(x).alias("dim"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from those before."""
    chosen = [int(np.argmax((sample**2).sum(axis=1)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))[:, None]], axis=1)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0))


def _products(q: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; ``exact``: no sum of products can leave the integers that doubles hold."""
    return (q.astype(float) @ v.T.astype(float)).astype(np.int64) if exact else q @ v.T


def _merged(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: higher score, then smaller id."""
    order = np.lexsort((ids, -score), axis=-1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def best_of_block(q: np.ndarray, q_ids: np.ndarray, to: np.ndarray, least: np.ndarray, v: np.ndarray, ids: np.ndarray, table: np.ndarray, most: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of what can be among the k best of each query in a block, in bound order until nothing else can.

    to, table: distances of queries and candidates to the pivots; least: a score that k other candidates are known to reach.
    """
    none = np.iinfo(np.int64).min + 1
    if table.shape[1]:
        order = np.argsort(table.min(axis=1), kind="stable")
        v, ids, table = v[order], ids[order], table[order]
    starts = np.arange(0, len(ids), TOGETHER)
    far = np.zeros((len(q), len(starts)))
    for j in range(table.shape[1]):
        low, high = np.minimum.reduceat(table[:, j], starts), np.maximum.reduceat(table[:, j], starts)
        far = np.maximum(far, np.maximum(low - to[:, j, None], to[:, j, None] - high))
    size = (q.astype(float) ** 2).sum(axis=1)[:, None]
    upper = (size + most - far * far) / 2 + 1e-7 * (size + most) + 1e-3
    exact = math.sqrt(float(size.max(initial=0)) * most) < 2**52
    turn = np.argsort(-upper, axis=1, kind="stable")
    score, who = np.full((len(q), k), none), np.full((len(q), k), np.iinfo(np.int64).max)
    limit, rows = least.copy(), np.arange(len(q))
    for r in range(len(starts)):
        part = turn[:, r]
        rows = rows[upper[rows, part[rows]] >= limit[rows]]  # later bounds are no higher
        if not len(rows):
            break
        for s in np.unique(part[rows]):
            own = rows[part[rows] == s]
            x = slice(starts[s], starts[s] + TOGETHER)
            found = _products(q[own], v[x], exact)
            found[ids[x][None, :] == q_ids[own][:, None]] = none
            some = (found >= limit[own][:, None]).any(axis=1)
            own, found = own[some], found[some]
            if len(own):
                both = np.concatenate([score[own], found], axis=1), np.concatenate([who[own], np.broadcast_to(ids[x], found.shape)], axis=1)
                score[own], who[own] = _merged(*both, k)
                limit[own] = np.maximum(limit[own], score[own, -1])
    at, place = np.nonzero((score > none) & (score >= least[:, None]))
    return at, who[at, place], score[at, place]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of each query.

    vectors: id, v, dim, as from integers(); is_query: over id.
    """
    rows = cut(vectors)
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    norms = rows.groupBy("dim").agg(F.max(norm).alias("m"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS)
    most = {r["dim"]: r["m"] for r in norms.collect()}
    sample: dict[int, list] = {}
    near = rows.where(F.col("dim").isin(list(most))).withColumn("_r", F.row_number().over(W.partitionBy("dim", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.xxhash64("id", "v")))).where(F.col("_r") <= SAMPLE // 64)
    for r in near.select("dim", "id", "v").toLocalIterator():
        sample.setdefault(r["dim"], []).append((r["id"], r["v"]))
    known = {d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.int64).reshape(len(x), d)) for d, x in sample.items()}
    pivots = {d: choose_pivots(_lifted(v.astype(float), most[d]), PIVOTS) for d, (_, v) in known.items()}

    def measured(batches: Iterator[pa.RecordBatch], asked: bool) -> Iterator[pa.RecordBatch]:
        """Adds distances to the pivots, the nearest of them, and for queries a score that k candidates reach."""
        for batch in batches:
            dims, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            out, nearest, least = [np.zeros(0)] * batch.num_rows, np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, np.iinfo(np.int64).min + 1)
            for d in np.unique(dims):
                if d not in pivots:
                    continue
                at = np.flatnonzero(dims == d)
                v = batch.column(1).take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)
                x = v.astype(float)
                to = _to_pivots(np.concatenate([x, np.zeros((len(x), 1))], axis=1) if asked else _lifted(x, most[d]), pivots[d])
                nearest[at] = to.argmin(axis=1)
                for i, row in zip(at, to, strict=True):
                    out[i] = row
                if asked:
                    their, w = known[d]
                    score = _products(v, w, math.sqrt(float((x**2).sum(axis=1).max(initial=0)) * most[d]) < 2**52)
                    score[their[None, :] == ids[at][:, None]] = least[0]
                    if len(their) >= k:
                        least[at] = np.partition(score, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.float64())), pa.array(nearest), pa.array(least)], names=["id", "v", "dim", "p", "near", "least"])

    kind = "id bigint, v array<bigint>, dim int, p array<double>, near int, least bigint"
    table = cut(rows.mapInArrow(tidy(partial(measured, asked=False)), kind))
    questions = cut(rows.where(is_query).distinct().mapInArrow(tidy(partial(measured, asked=True)), kind))

    def dealt(frame: DataFrame, size: int, groups: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
        """The rows in blocks ``b`` of about ``size`` with the same nearest pivot (of few rows, with neighbouring pivots); and each block's intervals."""
        frame = frame.withColumn("near", F.floor(F.col("near") * groups / PIVOTS).cast("int"))
        parts = frame.groupBy("dim", "near").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("parts"))
        own = frame.join(cut(parts), ["dim", "near"]).withColumn("b", F.xxhash64("near", F.pmod(F.xxhash64("id", "v"), F.col("parts")))).drop("parts")
        own = cut(own)
        ends = lambda f, name: F.array(*(f(F.get("p", F.lit(j))) for j in range(PIVOTS))).alias(name)
        return own, cut(own.groupBy("dim", "b").agg(ends(F.min, "low"), ends(F.max, "high"), F.min("least").alias("least"), F.max(norm).alias("size")))

    candidates, c_ends = dealt(table, BLOCK)
    asked, q_ends = dealt(questions, QUERIES, min(PIVOTS, max(1, math.ceil(questions.count() / QUERIES))))
    c = c_ends.select("dim", F.col("b").alias("cb"), F.col("low").alias("cl"), F.col("high").alias("ch"))
    m = F.create_map(*(F.lit(x) for d, v in most.items() for x in (int(d), float(v)))) if most else F.lit(None).cast("map<int,double>")
    apart = F.array_max(F.transform(F.arrays_zip("low", "high", "cl", "ch"), lambda e: F.greatest(e["cl"] - e["high"], e["low"] - e["ch"], F.lit(0.0))))
    upper = (F.col("size") + F.col("m") - F.coalesce(apart * apart, F.lit(0.0))) / 2 + 1e-7 * (F.col("size") + F.col("m")) + 1e-3
    pairs = q_ends.join(c, "dim").withColumn("m", F.try_element_at(m, F.col("dim"))).where(F.col("m").isNull() | (upper >= F.col("least"))).select("dim", "cb", F.col("b").alias("qb"))
    held = candidates.groupBy("dim", F.col("b").alias("cb")).agg(F.collect_list(F.struct("id", "v", "p")).alias("c"))
    wanted = asked.groupBy("dim", F.col("b").alias("qb")).agg(F.collect_list(F.struct("id", "v", "p", "least")).alias("q"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    copies = cut(pairs).join(wanted, ["dim", "qb"]).select("dim", "cb", "q").repartition(tasks, "dim", "cb")  # query blocks are copied, not the larger candidate blocks
    work = copies.join(held.repartition(tasks, "dim", "cb").hint("merge"), ["dim", "cb"]).select("dim", "c", "q")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                d = batch.column(0)[r].as_py()
                c, q = batch.column(1)[r].values, batch.column(2)[r].values
                ids, own = c.field("id").to_numpy(), q.field("id").to_numpy()
                v = c.field("v").flatten().to_numpy().reshape(len(ids), d)
                w = q.field("v").flatten().to_numpy().reshape(len(own), d)
                top = most[d] if d in most else float((v.astype(float) ** 2).sum(axis=1).max(initial=0))
                p, to = (x.field("p").flatten().to_numpy().reshape(n, -1) for x, n in ((c, len(ids)), (q, len(own))))
                at, who, score = best_of_block(w, own, to, q.field("least").to_numpy(), v, ids, p, top, k)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(who), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = work.mapInArrow(tidy(solve), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_rows(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``."""
    return top_k(integers(embeddings), F.col("id") % every == 0, k)
