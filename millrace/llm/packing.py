"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

1. Tokenise: the vocabulary's normaliser and pre-tokeniser never look across
   ASCII white space, so a text's ids are the ids of its words in order.  Ids of
   words seen before come from a bounded cache; only new words reach the tokeniser.
2. Deal the pieces round robin into partitions of about ``PART`` and pack each
   best-fit decreasing.
3. Certify: dual-feasible functions give a lower bound on the sequences of each
   partition (and, from the histogram of lengths, of the whole).
4. Repack: partitions above their bound release their emptiest sequences; the released pieces of all
   partitions are dealt anew and packed again, while that saves sequences.

Only (id, piece, length) rows move; texts and ids never do.  Defined results:
null text is empty and packs as the closing id alone; repeated rows are packed each
for itself; an empty table packs into nothing.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.staging import cut

#: Pieces of a partition, words kept in a worker's cache, repacking rounds at most.
PART, CACHE, ROUNDS = 1 << 16, 400_000, 3
#: ASCII characters other than letters, digits and the apostrophe: after a letter they begin a pre-token of their own.
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

_ENCODERS: dict[str, _Encoder] = {}


class _Encoder:
    """A worker's tokenizer, with caches from words and from words' letters to little-endian 32-bit ids.

    A word of letters and a tail of punctuation is two pre-tokens, so the letters' ids serve whatever follows them, in any ASCII case (the
    normaliser lower-cases).  Words of letters alone are encoded many at a time: each ends at the only id that closes a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.letters: dict[bytes, bytes] = {}

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _letters(self, new: list[bytes]) -> None:
        groups = [new[a : a + 200] for a in range(0, len(new), 200)]
        for own, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(own) or ends[-1] != len(ids):
                self.letters.update(zip(own, self._one_by_one(own), strict=True))
                continue
            raw, a = ids.tobytes(), 0
            for w, b in zip(own, (4 * ends).tolist(), strict=True):
                self.letters[w] = raw[a:b]
                a = b

    def learn(self, new: list[bytes]) -> None:
        """Adds words to the cache."""
        if len(self.letters) > CACHE:
            self.letters.clear()
        parted, odd = [], []
        for w in new:
            low = w.lower()
            core = low.rstrip(PUNCTUATION)
            (parted if core.decode().lower().isalpha() else odd).append((w, core, low[len(core) :]))
        self._letters(list({core for _, core, _ in parted}.difference(self.letters)))
        tails = list({tail for _, _, tail in parted if tail})
        of_tail = dict(zip(tails, self._one_by_one(tails), strict=True)) | {b"": b""}
        for w, core, tail in parted:
            self.words[w] = self.letters[core] + of_tail[tail]
        self.words.update(zip((w for w, _, _ in odd), self._one_by_one([w for w, _, _ in odd]), strict=True))


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def encode_words(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text, as little-endian 32-bit integers."""
    encoder = _encoder(path)
    split = [t.encode().split() for t in texts]
    seen = set().union(*split)
    new = seen.difference(encoder.words)
    if len(encoder.words) + len(new) > CACHE:
        encoder.words.clear()
        new = seen
    encoder.learn(list(new))
    return [b"".join(map(encoder.words.__getitem__, s)) for s in split]


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                row, piece, length, crc = [], [], [], []
                for i, ids in enumerate(encode_words([t.as_py() or "" for t in part.column(1)], path)):
                    ids += closing
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                k = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(k.astype(np.int32)), pa.array(k * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs; counts[s]: pieces of length s.

    The largest of the dual-feasible functions' sums: u_k rounds (k + 1) s / capacity down to a share of k unless it is whole; f_t ignores pieces
    shorter than t and fills the sequence of any that is longer than capacity - t.
    """
    s = np.arange(len(counts))
    total = int((s * counts).sum())
    best = -(-total // capacity)
    for k in range(1, 25):
        x = (k + 1) * s
        share = np.where(x % capacity == 0, k * s / capacity, x // capacity)
        best = max(best, math.ceil(float((share * counts).sum()) / k - 1e-6))
    run, mass = np.cumsum(counts), np.cumsum(s * counts)
    for t in range(1, capacity // 2 + 1):
        big = int(run[-1] - run[capacity - t])
        middle = int(mass[capacity - t] - mass[t - 1])
        best = max(best, big + -(-middle // capacity))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's bin and offset, and each bin's room left."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: dict[int, list[int]] = {}
    some = 0  # bit r: some bin has room r
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        where[i], offset[i] = b, capacity - r
        room[b] = r - n
        if r > n:
            by_room.setdefault(r - n, []).append(b)
            some |= 1 << (r - n)
    return where, offset, np.array(room, np.int64)


def _packed(rows: DataFrame, parts: int, capacity: int, turn: int) -> DataFrame:
    """rows with sequence_id, offset and release: whether the partition offers that sequence for repacking."""
    names = [c for c in rows.columns if c not in ("sequence_id", "offset", "release")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        lengths = table.column("length").to_numpy()
        bins, offset, room = best_fit(lengths, capacity)
        over = len(room) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        offered = np.zeros(len(room), bool)
        if over > 0:
            offered[np.argsort(-room, kind="stable")[: 8 * over]] = True
            offered &= room > 0
        part = TaskContext.get().partitionId()
        ids = ((turn << 24) + part << 24) + bins
        for b in table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).append_column("release", pa.array(offered[bins])).to_batches(10_000):
            yield b

    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("release", T.BooleanType())])
    return cut(rows.select(*names).repartition(parts).mapInArrow(run, schema))


def pack(rows: DataFrame, capacity: int = 4096, part: int = PART, rounds: int = ROUNDS) -> DataFrame:
    """rows, which have a ``length`` from 1 to capacity, with sequence_id and offset."""
    n = rows.count()
    done = _packed(rows, max(1, math.ceil(n / part)), capacity, 0)
    need = bound_of_all(rows, capacity)
    for turn in range(1, rounds + 1):
        made, offered, size = done.agg(F.countDistinct("sequence_id"), F.countDistinct(F.when(F.col("release"), F.col("sequence_id"))), F.sum(F.col("release").cast("long"))).first()
        if made <= need or not offered:
            break
        again = _packed(done.where("release"), max(1, math.ceil(size / part)), capacity, turn)
        if again.agg(F.countDistinct("sequence_id")).first()[0] >= offered:
            break
        done = done.where(~F.col("release")).unionByName(again)
    return done.drop("release")


def bound_of_all(rows: DataFrame, capacity: int = 4096) -> int:
    """The certified least number of sequences, from at most ``capacity`` counts."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return lower_bound(counts, capacity)


def packed_documents(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(cut(pieces(docs, path, capacity)), capacity)


def sequences(docs: DataFrame, packed: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """sequence_id and ids (array<int>), the training sequences themselves, from the documents and their packing (unique ids)."""
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = [], []
            for i, whole in enumerate(encode_words([t.as_py() or "" for t in batch.column(1)], path)):
                whole += closing
                row.append(i)
                ids.append(np.frombuffer(whole, "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    encoded = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")
    placed = packed.join(encoded, "doc_id").select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("part"))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"])).alias("ids"))
