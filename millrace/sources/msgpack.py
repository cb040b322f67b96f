"""MessagePack encoding and decoding of plain values (nil, bool, int, float, str, bytes, list, dict)."""

from __future__ import annotations

import struct
from collections.abc import Iterator


def pack(x: object) -> bytes:
    if x is None:
        return b"\xc0"
    if x is True or x is False:
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        if 0 <= x < 128:
            return bytes([x])
        if -32 <= x < 0:
            return struct.pack("b", x)
        for low, high, tag, form in ((0, 1 << 8, 0xCC, ">B"), (0, 1 << 16, 0xCD, ">H"), (0, 1 << 32, 0xCE, ">I"), (0, 1 << 64, 0xCF, ">Q"), (-(1 << 7), 0, 0xD0, ">b"), (-(1 << 15), 0, 0xD1, ">h"), (-(1 << 31), 0, 0xD2, ">i"), (-(1 << 63), 0, 0xD3, ">q")):
            if low <= x < high:
                return bytes([tag]) + struct.pack(form, x)
        raise OverflowError("integers have 64 bits at most")
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        raw = x.encode()
        return _head(len(raw), 0xA0, 32, (0xD9, 0xDA, 0xDB)) + raw
    if isinstance(x, bytes | bytearray):
        return _head(len(x), None, 0, (0xC4, 0xC5, 0xC6)) + bytes(x)
    if isinstance(x, list | tuple):
        return _head(len(x), 0x90, 16, (None, 0xDC, 0xDD)) + b"".join(map(pack, x))
    if isinstance(x, dict):
        return _head(len(x), 0x80, 16, (None, 0xDE, 0xDF)) + b"".join(pack(k) + pack(v) for k, v in x.items())
    raise TypeError(f"cannot pack {type(x).__name__}")


def _head(n: int, small: int | None, limit: int, tags: tuple) -> bytes:
    if small is not None and n < limit:
        return bytes([small | n])
    for tag, form, most in zip(tags, (">B", ">H", ">I"), (1 << 8, 1 << 16, 1 << 32), strict=True):
        if tag is not None and n < most:
            return bytes([tag]) + struct.pack(form, n)
    raise OverflowError("too long")


def _unpack(b: bytes, i: int) -> tuple[object, int]:
    t = b[i]
    i += 1
    if t < 0x80:
        return t, i
    if t >= 0xE0:
        return t - 256, i
    if t < 0x90:
        return _map(b, i, t & 15)
    if t < 0xA0:
        return _list(b, i, t & 15)
    if t < 0xC0:
        return _take(b, i, t & 31, str)
    if t in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[t], i
    fixed = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if t in fixed:
        n = struct.calcsize(fixed[t])
        if i + n > len(b):
            raise ValueError("truncated record")
        return struct.unpack_from(fixed[t], b, i)[0], i + n
    sized = {0xC4: (">B", bytes), 0xC5: (">H", bytes), 0xC6: (">I", bytes), 0xD9: (">B", str), 0xDA: (">H", str), 0xDB: (">I", str), 0xDC: (">H", list), 0xDD: (">I", list), 0xDE: (">H", dict), 0xDF: (">I", dict)}
    if t not in sized:
        raise ValueError(f"unsupported tag {t:#x}")
    form, kind = sized[t]
    n = struct.unpack_from(form, b, i)[0]
    i += struct.calcsize(form)
    return _list(b, i, n) if kind is list else _map(b, i, n) if kind is dict else _take(b, i, n, kind)


def _take(b: bytes, i: int, n: int, kind: type) -> tuple[object, int]:
    if i + n > len(b):
        raise ValueError("truncated record")
    return (b[i : i + n].decode() if kind is str else b[i : i + n]), i + n


def _list(b: bytes, i: int, n: int) -> tuple[list, int]:
    out = []
    for _ in range(n):
        x, i = _unpack(b, i)
        out.append(x)
    return out, i


def _map(b: bytes, i: int, n: int) -> tuple[dict, int]:
    out = {}
    for _ in range(n):
        k, i = _unpack(b, i)
        out[k], i = _unpack(b, i)
    return out, i


def unpack_all(b: bytes) -> Iterator[object]:
    """Concatenated records up to the end; a record cut short is an error."""
    i = 0
    while i < len(b):
        try:
            x, i = _unpack(b, i)
        except (IndexError, struct.error) as e:
            raise ValueError("truncated record") from e
        yield x
