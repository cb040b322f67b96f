"""Codecs by file extension or by the first bytes; more can be registered."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO


@dataclass(frozen=True)
class Codec:
    name: str
    extensions: tuple[str, ...]
    magic: bytes
    compress: Callable[[bytes], bytes]
    decompress: Callable[[bytes], bytes]
    #: A file of the plain bytes, read piece by piece.
    open: Callable[[BinaryIO], BinaryIO] | None = None
    #: Whether what is compressed piece by piece may be joined to one file.
    joins: bool = False


def _zstd_compress(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(raw)


def _zstd_decompress(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw)


def _zstd_open(f: BinaryIO) -> BinaryIO:
    import zstandard

    return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True))


#: Fixed values of the formats: extensions and first bytes.
CODECS: list[Codec] = [
    Codec("gzip", (".gz", ".gzip"), b"\x1f\x8b", gzip.compress, gzip.decompress, gzip.open, True),
    Codec("zstd", (".zst", ".zstd"), b"\x28\xb5\x2f\xfd", _zstd_compress, _zstd_decompress, _zstd_open, True),
    Codec("bzip2", (".bz2", ".bzip2"), b"BZ", bz2.compress, bz2.decompress, bz2.open, True),
    Codec("xz", (".xz",), b"\xfd7zXZ\x00", lzma.compress, lzma.decompress, lzma.open, True),
]


def register_codec(codec: Codec) -> None:
    """Adds a codec for all later reads and writes of this driver."""
    CODECS.append(codec)


def by_extension(path: str) -> Codec | None:
    return next((c for c in CODECS if path.lower().endswith(c.extensions)), None)


def detect(path: str, head: bytes) -> Codec | None:
    """By extension, else by the first bytes."""
    return by_extension(path) or next((c for c in CODECS if c.magic and head.startswith(c.magic)), None)


def plain(path: str, raw: bytes) -> bytes:
    codec = detect(path, raw[:16])
    return codec.decompress(raw) if codec else raw


def chunks(path: str, raw: bytes, size: int) -> Iterator[bytes]:
    """The plain bytes in pieces of about ``size`` that end with a line."""
    codec = detect(path, raw[:16])
    f = codec.open(io.BytesIO(raw)) if codec and codec.open else io.BytesIO(codec.decompress(raw) if codec else raw)
    while piece := f.read(size):
        yield piece + f.readline()
