"""Sorted keys with counts, packed small for a shuffle."""

from __future__ import annotations

import numpy as np
import zstandard


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together: the high ones are mostly zero and compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as deltas."""
    if not len(keys):
        return b""
    return zstandard.ZstdCompressor(level=1).compress(_planes(np.diff(keys, prepend=np.uint64(0))))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(zstandard.ZstdDecompressor().decompress(data), np.uint64), dtype=np.uint64) if data else np.zeros(0, np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    """Non-negative whole numbers, mostly small."""
    if not len(values):
        return b""
    return zstandard.ZstdCompressor(level=1).compress(_planes(np.ascontiguousarray(values, np.uint64)))


def unpack_numbers(data: bytes) -> np.ndarray:
    return _unplanes(zstandard.ZstdDecompressor().decompress(data), np.uint64).astype(np.int64) if data else np.zeros(0, np.int64)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sum of each value over equal keys."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each stands."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))
