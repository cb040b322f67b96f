"""Byte-level BPE by a rank file: encoding of whole texts and decoding to raw bytes.

Long texts are cut before they are encoded, at places where no match of the
pattern can cross: before a space or line feed that follows a character other than
white space.  (A match takes white space only as its first character or as white space alone, and the rule that looks ahead from
white space never sees the cut.)  Ids are therefore those of the whole text.

Defined results: null text is empty and has no ids; texts with no safe cut are encoded in one piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters after which the next safe cut is taken.
CHUNK = 1 << 16
_CUT = re.compile(r"(?<=\S)[ \n]")
_LOADED: dict[tuple[str, str], tuple] = {}


def loaded(path: str, pattern: str) -> tuple:
    """This worker's encoding for a rank file, and each id as decimal text."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path, pattern] = (tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), [str(i) for i in range(max(ranks.values()) + 1)])
    return _LOADED[path, pattern]


def parts(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in pieces that can be encoded one by one."""
    a = 0
    while len(text) - a > size:
        m = _CUT.search(text, a + size)
        if not m:
            break
        yield text[a : m.start()]
        a = m.start()
    yield text[a:] if a else text


def encode(text: str, path: str, pattern: str) -> list[int]:
    encoding, _ = loaded(path, pattern)
    return [i for p in parts(text) for i in encoding.encode_ordinary(p)]


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    return loaded(path, pattern)[0].decode_bytes(ids)


def encoded_rows(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, names = loaded(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                count, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for p in parts(text.as_py() or ""):
                    ids = encoding.encode_ordinary(p)
                    if ids:
                        a.update(((" " if count else "") + " ".join(map(names.__getitem__, ids))).encode())
                        b.update(encoding.decode_bytes(ids))
                        count += len(ids)
                n.append(count)
                ids_sha.append(a.hexdigest())
                text_sha.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def with_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(t.as_py() or "", path, pattern) for t in batch.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")
