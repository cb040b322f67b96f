"""Avro object container files: reading and writing plain records.

Types: null, boolean, int, long, float, double, bytes, string, fixed, enum, array, map, record and unions; codecs: null, deflate, zstandard, bzip2, xz.
"""

from __future__ import annotations

import bz2
import io
import json
import lzma
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

MAGIC = b"Obj\x01"


def _zstd(raw: bytes, back: bool) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw) if back else zstandard.ZstdCompressor().compress(raw)


CODECS = {
    "null": (bytes, bytes), "deflate": (lambda b: zlib.compress(b)[2:-4], lambda b: zlib.decompress(b, -15)), "zstandard": (lambda b: _zstd(b, False), lambda b: _zstd(b, True)),
    "bzip2": (bz2.compress, bz2.decompress), "xz": (lzma.compress, lzma.decompress),
}


def _long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n & ~0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_long(f: io.BytesIO) -> int:
    n = shift = 0
    while True:
        byte = f.read(1)
        if not byte:
            raise EOFError("truncated number")
        n |= (byte[0] & 0x7F) << shift
        if not byte[0] & 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


class Schema:
    """A parsed schema with the named types it defines."""

    def __init__(self, text: str | dict | list):
        self.json = json.loads(text) if isinstance(text, str) and text.lstrip()[:1] in "{[\"" else text
        self.names: dict[str, object] = {}
        self._collect(self.json)

    def _collect(self, s: object) -> None:
        if isinstance(s, list):
            for x in s:
                self._collect(x)
        elif isinstance(s, dict):
            if "name" in s and s.get("type") in ("record", "enum", "fixed"):
                self.names[s["name"]] = s
            for f in s.get("fields", ()):
                self._collect(f["type"])
            for k in ("items", "values"):
                if k in s:
                    self._collect(s[k])
            if isinstance(s.get("type"), dict | list):
                self._collect(s["type"])

    def _of(self, s: object) -> tuple[str, object]:
        if isinstance(s, list):
            return "union", s
        if isinstance(s, dict):
            return self._of(s["type"]) if isinstance(s["type"], dict | list) else (s["type"], s)
        return self._of(self.names[s]) if s in self.names else (s, s)

    def write(self, s: object, x: object) -> bytes:
        kind, s = self._of(s)
        match kind:
            case "null":
                return b""
            case "boolean":
                return bytes([bool(x)])
            case "int" | "long":
                return _long(int(x))
            case "float":
                return struct.pack("<f", x)
            case "double":
                return struct.pack("<d", x)
            case "bytes" | "string":
                raw = x.encode() if isinstance(x, str) else bytes(x)
                return _long(len(raw)) + raw
            case "fixed":
                return bytes(x)
            case "enum":
                return _long(s["symbols"].index(x))
            case "array":
                return (_long(len(x)) + b"".join(self.write(s["items"], y) for y in x) if len(x) else b"") + b"\x00"
            case "map":
                return (_long(len(x)) + b"".join(self.write("string", k) + self.write(s["values"], v) for k, v in x.items()) if x else b"") + b"\x00"
            case "record":
                return b"".join(self.write(f["type"], x.get(f["name"], f.get("default"))) for f in s["fields"])
            case "union":
                i = next((i for i, o in enumerate(s) if self._fits(o, x)), None)
                if i is None:
                    raise ValueError(f"{x!r} fits no branch of {s}")
                return _long(i) + self.write(s[i], x)
        raise ValueError(f"unknown type {kind}")

    def _fits(self, s: object, x: object) -> bool:
        kind, _ = self._of(s)
        fits = {"null": type(None), "boolean": bool, "int": int, "long": int, "float": (float, int), "double": (float, int), "string": str, "enum": str, "bytes": (bytes, bytearray), "fixed": (bytes, bytearray), "array": (list, tuple), "map": dict, "record": dict}
        return isinstance(x, fits[kind]) and not (isinstance(x, bool) and kind not in ("boolean",))

    def read(self, s: object, f: io.BytesIO) -> object:
        kind, s = self._of(s)
        match kind:
            case "null":
                return None
            case "boolean":
                return f.read(1) == b"\x01"
            case "int" | "long":
                return _read_long(f)
            case "float":
                return struct.unpack("<f", f.read(4))[0]
            case "double":
                return struct.unpack("<d", f.read(8))[0]
            case "bytes":
                return f.read(_read_long(f))
            case "string":
                return f.read(_read_long(f)).decode()
            case "fixed":
                return f.read(s["size"])
            case "enum":
                return s["symbols"][_read_long(f)]
            case "array":
                return [x for x in self._blocks(f, lambda: self.read(s["items"], f))]
            case "map":
                return dict(self._blocks(f, lambda: (self.read("string", f), self.read(s["values"], f))))
            case "record":
                return {x["name"]: self.read(x["type"], f) for x in s["fields"]}
            case "union":
                return self.read(s[_read_long(f)], f)
        raise ValueError(f"unknown type {kind}")

    @staticmethod
    def _blocks(f: io.BytesIO, one) -> Iterator:
        while n := _read_long(f):
            if n < 0:
                n = -n
                _read_long(f)
            for _ in range(n):
                yield one()


def read(data: bytes, schema: str | dict | None = None) -> Iterator[dict]:
    """The records of a container; with a reader's schema only its fields, defaults where the file lacks them."""
    f = io.BytesIO(data)
    if f.read(4) != MAGIC:
        raise ValueError("not an Avro container")
    meta = Schema({"type": "map", "values": "bytes"}).read({"type": "map", "values": "bytes"}, f)
    sync = f.read(16)
    written = Schema(meta["avro.schema"].decode())
    back = CODECS[meta.get("avro.codec", b"null").decode()][1]
    wanted = Schema(schema).json["fields"] if schema else None
    while f.tell() < len(data):
        n, size = _read_long(f), _read_long(f)
        block = io.BytesIO(back(f.read(size)))
        for _ in range(n):
            row = written.read(written.json, block)
            yield row if wanted is None else {x["name"]: row[x["name"]] if x["name"] in row else x["default"] for x in wanted}
        if f.read(16) != sync:
            raise ValueError("broken block")


def header(schema: str | dict, codec: str, sync: bytes) -> bytes:
    """What a container begins with; ``blocks`` with the same marker follow, from any number of writers."""
    kind = {"type": "map", "values": "bytes"}
    return MAGIC + Schema(kind).write(kind, {"avro.schema": json.dumps(Schema(schema).json).encode(), "avro.codec": codec.encode()}) + sync


def blocks(rows: Iterable[dict], schema: str | dict, codec: str, sync: bytes, block: int = 4000) -> bytes:
    s = Schema(schema)
    out: list[bytes] = []
    held: list[bytes] = []

    def flush() -> None:
        raw = CODECS[codec][0](b"".join(held))
        out.extend((_long(len(held)), _long(len(raw)), raw, sync))
        held.clear()

    for row in rows:
        held.append(s.write(s.json, row))
        if len(held) == block:
            flush()
    if held:
        flush()
    return b"".join(out)


def write(rows: Iterable[dict], schema: str | dict, codec: str = "deflate", block: int = 4000) -> bytes:
    sync = os.urandom(16)
    return header(schema, codec, sync) + blocks(rows, schema, codec, sync, block)
