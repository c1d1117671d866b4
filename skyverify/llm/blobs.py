"""Arrays of numbers as compact bytes, for messages between tasks."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEAD = struct.Struct("<cBqq")
_codec: list = []


def _zstd() -> tuple:
    if not _codec:
        _codec.append((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _codec[0]


def pack(*arrays: np.ndarray) -> bytes:
    """Integer and float arrays, byte by byte and compressed.  Floats keep their width; integers without a negative one take as few bytes as the largest needs."""
    out = []
    for a in arrays:
        if a.dtype.kind == "f":
            kind, wide = b"f", a.dtype.itemsize
            raw = np.ascontiguousarray(a, f"<f{wide}")
        else:
            low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
            wide = 8 if low < 0 else next(w for w in (1, 2, 4, 8) if high < 1 << 8 * w)
            raw = np.ascontiguousarray(a, f"<{'i' if low < 0 else 'u'}{wide}")
            kind = b"i" if low < 0 else b"u"
        packed = _zstd()[0].compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, wide).T).tobytes())
        out += [_HEAD.pack(kind, wide, len(a), len(packed)), packed]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``, as 64-bit numbers."""
    out, at = [], 0
    while at < len(data):
        kind, wide, n, size = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        planes = np.frombuffer(_zstd()[1].decompress(data[at : at + size]), np.uint8).reshape(wide, n)
        at += size
        got = np.ascontiguousarray(planes.T).reshape(-1).view(f"<{kind.decode()}{wide}")
        out.append(got.astype(np.float64 if kind == b"f" else np.int64))
    return out
