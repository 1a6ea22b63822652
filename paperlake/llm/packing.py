"""Compact blocks of (document, position) pairs and of fingerprints for a shuffle."""

from __future__ import annotations

import numpy as np
import zstandard


def pack_ints(values: np.ndarray) -> bytes:
    """Differences of whole numbers, compressed; order is kept."""
    v = np.asarray(values, np.int64)
    d = np.diff(v, prepend=0)
    small = len(d) == 0 or (d.min() >= -(1 << 31) and d.max() < 1 << 31)
    return (b"4" if small else b"8") + zstandard.ZstdCompressor(1).compress(d.astype("<i4" if small else "<i8").tobytes())


def unpack_ints(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob[1:])
    return np.cumsum(np.frombuffer(raw, "<i4" if blob[:1] == b"4" else "<i8").astype(np.int64))


def split_by(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by a small key, its distinct values and their borders in that order."""
    order = np.argsort(key.astype(np.uint16) if len(key) == 0 or key.max() < 1 << 16 else key, kind="stable")
    k = key[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return order, k[cut], np.r_[cut, len(k)]
