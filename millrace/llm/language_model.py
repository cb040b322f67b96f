"""A log-bilinear language model, trained in numpy with noise-contrastive estimation.

The two words before a word predict a vector, r = c1 * R[w1] + c2 * R[w2]; a word scores r . Q[w] + b[w].  The
model's classes are the end of a text, the most frequent words, and ``groups`` groups that all rarer words are dealt
into by their checksum; inside a group a word has its smoothed share of the counts.  So every text has a normalised
probability, and no word is without a class that learns.

As context a word has a vector of its own or, if rarer, one that it shares with the words of its checksum.  There are
as many of these vectors as the vocabulary asks for, 4 times its square root (a power of 2, ``MOST`` at most: 35 MB
with the sums of AdaGrad), so what the model gathers grows with the corpus and the workers' parameters stay bounded.

* Counts: every training word, with map-side combine; nothing is sampled.
* Lookup: words with the highest counts, ``HEAD`` at most and of ``LONGEST`` bytes at most, go to the workers; the rest of
  each text's words join the count table.
* Training: ``rounds`` passes over parts of all training texts.  Each task does NCE with shared noise samples on its
  own rows, starting from the same parameters, and the tasks' parameters are averaged in a tree, 8 at a time.
* Scoring: a context is a sum, so the exponential of its score is a product with one factor for each of its two words.
  Contexts are dealt into blocks by their words; a block with many of them gets its exact normalisers by one matrix
  product, the contexts of other blocks by inner products.

Defined results: null text has the end token only; a null id is held out by the checksum of the empty text; repeated
rows count and score each for itself; without training rows counts are zero and the model is uniform over its classes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import crc32_mod, tidy
from millrace.plans.staging import cut

HEAD, LONGEST = 1 << 19, 64
#: Context vectors at most, and how many sets of parameters a task averages.
MOST, FAN = 1 << 18, 8
END = 1
LN10 = math.log(10)


def _parts(texts: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of texts of up to ``size`` bytes (or one text)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a, done = 0, 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, done + size, "right")))
        yield a, b
        a, done = b, int(ends[b - 1])


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, which of them each token is, and where each text's tokens begin and end."""
    lower = pc.ascii_lower(pc.fill_null(texts, ""))  # only A-Z change, only ASCII white space parts words
    split = pc.ascii_split_whitespace(lower)
    found = split.flatten().dictionary_encode()
    which, bounds = found.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    none = pc.index(found.dictionary, "").as_py()  # at the ends of a text
    if none >= 0:
        full = which != none
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds - bounds[0]]
        which = which[full]
    return found.dictionary, which, bounds - bounds[0]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c: how often each word occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _parts(batch.column(0)):
                words, which, _ = _tokens(batch.column(0).slice(a, b - a))
                n = np.bincount(which, minlength=len(words))
                found = pa.RecordBatch.from_arrays([words, pa.array(n)], names=["word", "c"]).filter(pa.array(n > 0))
                for c in range(0, len(found), 50_000):
                    yield found.slice(c, 50_000)

    return docs.select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Lookup:
    """Counts of all training words in sum, by group of rarer words, and one by one for the head."""

    def __init__(self, vocab: DataFrame, texts: int, classes: int, groups: int):
        n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.texts, self.n, self.v = texts, n + texts, v + (texts > 0)
        level = F.floor(64 * F.log2("c")).cast("int")
        short = vocab.where(F.octet_length("word") <= LONGEST)
        bins = sorted(((r["b"], r["n"]) for r in short.groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        total, least = 0, 1 << 30
        for b, k in bins:  # whole levels of frequency, from the top
            if total + k > HEAD:
                break
            total, least = total + k, b
        rows = short.where(level >= least).collect()
        rows.sort(key=lambda r: (-r["c"], r["word"]))
        words = [(r["word"].encode(), r["c"]) for r in rows]
        self.groups, top = groups, words[: classes - 1 - groups]
        self.classes = 1 + len(top) + groups
        #: The class of each group: 0, and those behind the end and the most frequent words.
        self.grouped = np.concatenate([[0], np.arange(2 + len(top), self.classes)]).astype(np.int64)
        self.vectors = min(MOST, 1 << max(10, math.ceil(math.log2(4 * math.sqrt(v + 1)))))
        self.own = min(len(words), self.vectors // 2)
        #: The place of each word of the head; by place its class, context vector and log10(count + 1), those of other words last.
        self.places = {w: i for i, (w, _) in enumerate(words)}
        place = np.arange(len(words))
        group, shared = self.rarer(np.fromiter((zlib.crc32(w) for w, _ in words), np.int64, len(words)))
        self.class_of = np.append(np.where(place < len(top), place + 2, group), -1)
        self.vector_of = np.append(np.where(place < self.own, place + 2, shared), -1)
        self.log_of = np.log10(np.array([*(c + 1 for _, c in words), 1], float))
        sums = np.zeros((groups, 2))
        for r in vocab.groupBy(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(groups)).alias("g")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
            sums[r["g"]] = r["c"], r["v"]
        for w, c in top:
            sums[zlib.crc32(w) % groups] -= c, 1
        #: log10 of what a word's count + 1 is divided by inside each class that is a group.
        self.shares = np.zeros(self.classes)
        self.shares[self.grouped] = np.log10(sums.sum(axis=1) + 1)
        self.unigram = np.empty(self.classes)
        self.unigram[END] = texts + 1
        self.unigram[2 : 2 + len(top)] = [c for _, c in top]
        self.unigram[self.grouped] = sums[:, 0] + 1
        self.unigram /= self.unigram.sum()

    def rarer(self, checksums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes and context vectors (0, or one behind the end and the words' own) of words that have none of their own."""
        at = checksums % (self.vectors - self.own - 1)
        return self.grouped[checksums % self.groups], np.where(at > 0, at + self.own + 1, 0)


def encoded(docs: DataFrame, look: Lookup) -> DataFrame:
    """rid, doc_id, held_out, ids (classes, the end last), seen (context vectors), tokens, known, head_log, rare_log, tail (words outside the head)."""
    shared = docs.sparkSession.sparkContext.broadcast(look)
    end_log = math.log10(look.texts + 1)
    end_known = int(look.texts > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value
        find = look.places.get
        in_group = np.zeros(look.classes, bool)
        in_group[look.grouped] = True
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b in _parts(batch.column(2)):
                words, which, bounds = _tokens(batch.column(2).slice(a, b - a))
                of_words = words.cast(pa.binary()).to_pylist()
                place = np.fromiter(map(find, of_words, repeat(-1)), np.int64, len(of_words))
                own, vector, log = look.class_of[place], look.vector_of[place], look.log_of[place]
                out = np.flatnonzero(place < 0)
                own[out], vector[out] = look.rarer(np.fromiter((zlib.crc32(of_words[i]) for i in out), np.int64, len(out)))
                rare = log * in_group[own] - look.shares[own]
                text, beyond = np.repeat(np.arange(b - a), np.diff(bounds)), (place < 0)[which]
                n, tails = np.diff(bounds), np.bincount(text[beyond], minlength=b - a)
                cols = n + 1, n - tails + end_known, np.bincount(text, log[which], b - a) + end_log, np.bincount(text, rare[which], b - a)
                with_end = np.arange(len(which)) + text
                ids, seen = np.full(len(which) + b - a, END, np.int16), np.full(len(which) + b - a, END, np.int32)
                ids[with_end], seen[with_end] = own[which], vector[which]
                lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
                found = pa.RecordBatch.from_arrays([
                    pa.array(np.arange(rid + a, rid + b)), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                    lists(bounds + np.arange(b - a + 1), pa.array(ids)), lists(bounds + np.arange(b - a + 1), pa.array(seen)),
                    *(pa.array(x, pa.int64() if k < 2 else pa.float64()) for k, x in enumerate(cols)),
                    lists(np.concatenate([[0], np.cumsum(tails)]), words.take(pa.array(which[beyond]))),
                ], names=["rid", "doc_id", "held_out", "ids", "seen", "tokens", "known", "head_log", "rare_log", "tail"])
                for c in range(0, len(found), 512):
                    yield found.slice(c, 512)
            rid += batch.num_rows

    kind = dict(docs.dtypes)["doc_id"]
    return cut(docs.select("doc_id", "held_out", "text").mapInArrow(tidy(run), f"rid bigint, doc_id {kind}, held_out boolean, ids array<smallint>, seen array<int>, tokens bigint, known bigint, head_log double, rare_log double, tail array<string>"))


def start(look: Lookup, size: int = 32, seed: int = 7, vectors: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    k = look.classes
    p = {
        "R": rng.normal(0, 0.1, (vectors or k, size)).astype(np.float32), "Q": rng.normal(0, 0.1, (k, size)).astype(np.float32),
        "b": np.log(look.unigram).astype(np.float32), "C": np.ones((2, size), np.float32) * np.array([[1.0], [0.5]], np.float32),
    }
    # AdaGrad's sums go on from round to round; a context vector has one sum for all its elements
    return p | {f"{name} squares": np.ones_like(x[:, :1] if name == "R" else x) for name, x in p.items()}


def contexts(seen: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context vectors one and two places before each token; the end stands before a text."""
    one, two = np.empty_like(seen), np.empty_like(seen)
    one[1:], two[2:] = seen[:-1], seen[:-2]
    first = offsets[:-1]
    one[first] = two[first] = END
    second = first + 1
    two[second[second < offsets[1:]]] = END
    return one, two


def _distinct(at: np.ndarray, scratch: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct values of ``at``, a place of each, the other places, and which values these hold; ``scratch`` is overwritten at ``at``."""
    n = np.arange(len(at))
    scratch[at] = n
    last = scratch[at] == n
    own, again = np.flatnonzero(last), np.flatnonzero(~last)
    rows = at[own]
    scratch[rows] = n[: len(rows)]
    return rows, own, again, scratch[at[again]]


def _add_rows(into: np.ndarray, gains: np.ndarray, distinct: tuple[np.ndarray, ...], grad: np.ndarray, rate: float) -> None:
    """An AdaGrad step on the rows of ``distinct``, whose gradients are summed first."""
    rows, own, again, which = distinct
    g = grad.take(own, axis=0).astype(into.dtype, copy=False)
    if into.ndim == 1:
        np.add.at(g, which, grad[again])
        found = gains[rows] + g * g
    else:
        width = into.shape[1]
        places = (which * width)[:, None] + np.arange(width)
        np.add.at(g.reshape(-1), places.ravel(), grad.take(again, axis=0).ravel())  # repeated rows only; flat, as that is numpy's fast way
        square = g * g if gains.shape == into.shape else np.einsum("ij,ij->i", g, g)[:, None] / np.float32(width)
        found = gains.take(rows, axis=0) + square
    gains[rows] = found
    g *= np.float32(-rate) / np.sqrt(found)
    into[rows] = into.take(rows, axis=0) + g


def nce(p: dict[str, np.ndarray], batches: Iterator[tuple[np.ndarray, ...]], unigram: np.ndarray, noise: int = 32, rate: float = 0.3, size: int = 512, seed: int = 3) -> int:
    """Noise-contrastive estimation over flat ids with offsets and context vectors (left out: the ids); changes ``p``, returns how many tokens it read."""
    rng = np.random.default_rng(seed)
    gains = {k: p[f"{k} squares"] for k in "RQbC"}
    cumulative = np.cumsum(unigram)
    log_noise = np.log(noise * unigram).astype(np.float32)
    by_class, by_vector = np.empty(len(p["Q"]), np.int64), np.empty(len(p["R"]), np.int64)
    seen = 0
    for ids, offsets, *vectors in batches:
        one, two = contexts(vectors[0] if vectors else ids, offsets)
        order = rng.permutation(len(ids))
        for a in range(0, len(order), size):
            at = order[a : a + size]
            w, w1, w2 = ids[at], one[at], two[at]
            s = np.minimum(np.searchsorted(cumulative, rng.random(noise)), len(unigram) - 1)
            r1, r2, q, qs = p["R"].take(w1, axis=0), p["R"].take(w2, axis=0), p["Q"].take(w, axis=0), p["Q"].take(s, axis=0)
            c = p["C"]
            r = c[0] * r1 + c[1] * r2
            data = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", r, q) + p["b"][w] - log_noise[w]))) - 1
            fake = r @ -qs.T
            fake -= p["b"][s] - log_noise[s]
            np.exp(fake, out=fake)
            fake += 1
            np.reciprocal(fake, out=fake)
            dr = data[:, None] * q + fake @ qs
            targets = _distinct(np.concatenate([w, s]), by_class)
            of_targets, of_contexts = np.empty((len(w) + noise, q.shape[1]), r.dtype), np.empty((2, *r.shape), r.dtype)
            np.multiply(data[:, None], r, out=of_targets[: len(w)])
            np.matmul(fake.T, r, out=of_targets[len(w) :])
            np.multiply(dr, c[:, None], out=of_contexts)
            _add_rows(p["Q"], gains["Q"], targets, of_targets, rate)
            _add_rows(p["b"], gains["b"], targets, np.concatenate([data, fake.sum(axis=0)]), rate)
            _add_rows(p["R"], gains["R"], _distinct(np.concatenate([w1, w2]), by_vector), of_contexts.reshape(-1, r.shape[1]), rate)
            dc = np.stack([np.einsum("ij,ij->j", dr, r1), np.einsum("ij,ij->j", dr, r2)])
            gains["C"] += dc * dc
            p["C"] = c - 0.03 * rate * dc / np.sqrt(gains["C"])
        seen += len(ids)
    return seen


def _flat(column: pa.ListArray, seen: pa.ListArray, slice_words: int = 1 << 19, kind: type = np.int64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Flat ids, offsets and context vectors of some texts after the others; both columns have lists of the same lengths."""
    offsets, others = column.offsets.to_numpy().astype(np.int64), seen.offsets.to_numpy().astype(np.int64)
    flat, vectors = column.values.to_numpy(zero_copy_only=False), seen.values.to_numpy(zero_copy_only=False)
    a = 0
    while a < len(column):
        b = max(a + 1, min(len(column), int(np.searchsorted(offsets, offsets[a] + slice_words, "right")) - 1))
        yield flat[offsets[a] : offsets[b]].astype(kind), offsets[a : b + 1] - offsets[a], vectors[others[a] : others[b]].astype(kind)
        a = b


def train(rows: DataFrame, look: Lookup, rounds: int = 3, size: int = 32) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` rounds; each trains on its part of all texts that aren't held out."""
    p = start(look, size, vectors=look.vectors)
    names = list(p)
    shapes = [p[k].shape for k in names]
    unigram = look.unigram
    for turn in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            seed = 3 + 1_000_003 * turn + TaskContext.get().partitionId()  # each task and round draws noise of its own
            own = {k: x.copy() for k, x in shared.value.items()}
            seen = nce(own, (x for batch in batches for x in _flat(batch.column(0), batch.column(1))), unigram, seed=seed)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([float(seen)]), pa.array([np.concatenate([own[k].reshape(-1) for k in names]).astype("<f4").tobytes()], pa.binary())], names=["part", "n", "p"])

        def mean(t: pa.Table) -> pa.Table:
            n = t.column("n").to_numpy()
            total = sum(np.frombuffer(x.as_py(), "<f4").astype(float) * k for x, k in zip(t.column("p"), n, strict=True))
            return pa.table({"part": pa.array([t.column("g")[0].as_py()], pa.int64()), "n": [float(n.sum())], "p": pa.array([(total / n.sum()).astype("<f4").tobytes()], pa.binary())})

        kind = "part bigint, n double, p binary"
        made = rows.where(~F.col("held_out") & (F.pmod(F.xxhash64("rid"), F.lit(rounds)) == turn)).select("ids", "seen")
        left = made.rdd.getNumPartitions()
        made = made.mapInArrow(run, kind)
        while left > 1:  # a tree: few parameters meet in one task, one set reaches the driver
            left = -(-left // FAN)
            made = made.withColumn("g", F.pmod(F.col("part"), F.lit(left).cast("long"))).groupBy("g").applyInArrow(mean, kind)
        found = cut(made).collect()
        if found:
            n = sum(r["n"] for r in found)
            flat = sum(np.frombuffer(r["p"], "<f4").astype(float) * r["n"] for r in found) / n
            at = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
            p = {k: flat[at[i] : at[i + 1]].reshape(shapes[i]).astype(np.float32) for i, k in enumerate(names)}
    return p


def _factors(r: np.ndarray, q: np.ndarray, bias: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """exp(r . q + bias) over all classes, divided by each row's largest, and the log of that."""
    x = r @ q.T
    x += bias
    top = x.max(axis=1)
    x -= top[:, None]
    return np.exp(x, out=x), top


#: Words whose factors are held at once; first and second words of a block of contexts; what a context by itself costs, in those of a block.
FACTORS, FIRSTS, SECONDS, ALONE = 1 << 15, 256, 512, 24


def _seconds(p: dict[str, np.ndarray], words: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """The factors of words in the place before the last."""
    return _factors(p["C"][1] * p["R"][words], p["Q"], 0)


def _products(left: np.ndarray, right: np.ndarray, one: np.ndarray, two: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The inner product left[one] . right[two] of each context; ``edges``: where the contexts of each ``SECONDS`` rows of ``right`` begin and end."""
    total, alone = np.empty(len(one), right.dtype), []
    for j, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        block = right[j * SECONDS : (j + 1) * SECONDS]
        if (b - a) * ALONE > len(left) * len(block):  # one product for all pairs of words
            total[a:b] = (left @ block.T).ravel().take(one[a:b] * len(block) + two[a:b] - j * SECONDS)
        elif b > a:
            alone.append(np.arange(a, b))
    if alone:
        at = np.concatenate(alone)
        pair, back = np.unique(one[at] * len(right) + two[at], return_inverse=True)
        first, second = np.divmod(pair, len(right))
        found, begin = np.empty(len(pair), right.dtype), np.flatnonzero(np.diff(first, prepend=-1))
        if len(pair) >= 16 * len(begin):  # a product for each first word
            for a, b in zip(begin, [*begin[1:], len(pair)], strict=True):
                for c in range(a, b, 512):
                    found[c : min(b, c + 512)] = right.take(second[c : min(b, c + 512)], axis=0) @ left[first[a]]
        else:
            for c in range(0, len(pair), 512):
                found[c : c + 512] = np.einsum("ij,ij->i", left.take(first[c : c + 512], axis=0), right.take(second[c : c + 512], axis=0))
        total[at] = found[back]
    return total


def log_probabilities(p: dict[str, np.ndarray], ids: np.ndarray, offsets: np.ndarray, vectors: np.ndarray | None = None, seconds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The natural log probability of each token's class, normalised over all classes; contexts are ``vectors`` (left out: the ids), ``seconds`` the factors of all vectors, if at hand."""
    one, two = contexts(ids if vectors is None else vectors, offsets)
    k, classes = len(p["R"]), len(p["Q"])
    out = np.empty(len(ids))
    down, across = -(-k // FIRSTS), -(-min(k, FACTORS) // SECONDS)
    blocks = -(-k // FACTORS) * down * across
    block = ((two // FACTORS * down + one // FIRSTS) * across + two % FACTORS // SECONDS).astype(np.uint16 if blocks <= 1 << 16 else np.int64)
    order = np.argsort(block, kind="stable")  # 16 bits are sorted by counting
    bounds = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))])
    for h in range(0, k, FACTORS):
        right = None
        for i in range(down):
            place = (h // FACTORS * down + i) * across
            edges = bounds[place : place + across + 1]
            at = order[edges[0] : edges[-1]]
            if not len(at):
                continue
            if right is None:
                right = _seconds(p, slice(h, h + FACTORS))[0] if seconds is None else seconds[0][h : h + FACTORS]
            left = _factors(p["C"][0] * p["R"][i * FIRSTS : (i + 1) * FIRSTS], p["Q"], p["b"])[0]
            o, t, w = one[at].astype(np.int64) - i * FIRSTS, two[at].astype(np.int64) - h, ids[at].astype(np.int64)
            total = _products(left, right, o, t, edges - edges[0])
            own = left.ravel().take(o * classes + w) * right.ravel().take(t * classes + w)
            found = np.log(np.maximum(own, 1e-30).astype(float)) - np.log(np.maximum(total, 1e-20).astype(float))
            low = np.flatnonzero((total < 1e-20) | (own < 1e-30))  # the products vanish: the words favour classes too different
            for c in range(0, len(low), 512):
                n = low[c : c + 512]
                x = (p["C"][0] * p["R"][one[at[n]]] + p["C"][1] * p["R"][two[at[n]]]) @ p["Q"].T + p["b"]
                x -= x.max(axis=1)[:, None]
                found[n] = x[np.arange(len(n)), w[n]] - np.log(np.exp(x).sum(axis=1))
            out[at] = found
    return out


def scored(docs: DataFrame, classes: int = 1024, groups: int = 256, folds: int = 7, held: int = 2, rounds: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = docs.select("doc_id", "text").withColumn("held_out", crc32_mod(F.col("doc_id"), folds) == held)
    training = docs.where(~F.col("held_out"))
    vocab = cut(word_counts(training))
    look = Lookup(vocab, training.select("doc_id").count(), classes, groups)
    rows = encoded(docs, look)
    p = rows.sparkSession.sparkContext.broadcast(train(rows, look, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds = None
        for batch in batches:
            if seconds is None and len(p.value["R"]) <= FACTORS:
                seconds = _seconds(p.value)  # once a task
            total = [np.empty(0)]
            for ids, offsets, vectors in _flat(batch.column(1), batch.column(2), 1 << 20, np.int32):
                total.append(np.add.reduceat(log_probabilities(p.value, ids, offsets, vectors, seconds), offsets[:-1]) / LN10)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(total))], names=["rid", "model"])

    model = rows.select("rid", "ids", "seen").mapInArrow(tidy(run), "rid bigint, model double")
    tail = (
        rows.select("rid", F.explode("tail").alias("word")).join(vocab, "word")
        .groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("tail_log"), F.count(F.lit(1)).alias("tail_known"))
    )
    zero = lambda c, k: F.coalesce(F.col(c), F.lit(k))
    all_words = math.log10(look.n + look.v + 1)
    return rows.select("rid", "doc_id", "held_out", "tokens", "known", "head_log", "rare_log").join(model, "rid").join(tail, "rid", "left").select(
        "doc_id", "held_out", F.col("tokens").alias("n_tokens"), (F.col("known") + zero("tail_known", 0)).alias("n_known"), F.lit(look.n).cast("long").alias("train_tokens"),
        (F.col("head_log") + zero("tail_log", 0.0) - F.col("tokens") * F.lit(all_words)).alias("base_score"),
        (F.col("model") + F.col("rare_log") + zero("tail_log", 0.0)).alias("score"),
    )
