"""Arrays as compressed bytes, to be sent between tasks in one row."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64, np.float32, np.float64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of floats or whole numbers from 0 in as few bytes each as the largest needs, by byte planes, compressed."""
    head, body = [], []
    for a in arrays:
        a = np.asarray(a)
        if a.dtype.kind in "iub":
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<BQ", [np.dtype(k) for k in _KINDS].index(a.dtype), len(a)))
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    raw = b"".join(body)
    return struct.pack("<BQ", len(arrays), len(raw)) + b"".join(head) + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(data: bytes) -> list[np.ndarray]:
    """What pack() was given; whole numbers as int64, or as uint64 where they need it."""
    n, size = struct.unpack_from("<BQ", data)
    heads = [struct.unpack_from("<BQ", data, 9 * (i + 1)) for i in range(n)]
    raw = pa.decompress(data[9 * (n + 1) :], size, "zstd", asbytes=True) if size else b""
    out, at = [], 0
    for kind, length in heads:
        dtype = np.dtype(_KINDS[kind])
        planes = np.frombuffer(raw, np.uint8, length * dtype.itemsize, at).reshape(dtype.itemsize, length)
        a = np.ascontiguousarray(planes.T).view(dtype).reshape(length)
        out.append(a.astype(np.int64) if kind < 3 else a)
        at += length * dtype.itemsize
    return out


def steps(rising: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, which pack smaller; np.cumsum gives them back."""
    return np.diff(rising, prepend=rising.dtype.type(0))
