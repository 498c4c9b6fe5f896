"""Arrays as compressed bytes, for rows that carry many numbers at once."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: sorted uint64 by differences, all with their bytes regrouped, compressed."""
    parts = []
    for a in arrays:
        body = np.diff(a, prepend=np.uint64(0)) if a.dtype == np.uint64 else a
        planes = np.ascontiguousarray(body).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        parts += [f"{a.dtype.str}:{len(a)};".encode(), planes]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    while at < len(raw):
        end = raw.index(b";", at)
        kind, _, n = raw[at:end].decode().rpartition(":")
        dtype, n = np.dtype(kind), int(n)
        size = n * dtype.itemsize
        body = np.frombuffer(raw, np.uint8, size, end + 1).reshape(dtype.itemsize, n).T
        a = np.ascontiguousarray(body).view(dtype).reshape(n)
        out.append(np.cumsum(a, dtype=np.uint64) if dtype == np.uint64 else a)
        at = end + 1 + size
    return out


def small(a: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that is not the one of sorted keys."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted 64-bit hashes pass from range to range of the hash."""
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)
