"""Vectorised token kernels over Arrow string buffers.

Words are byte runs between separators. A word's fingerprint is a sum of random numbers that stand
for its bytes, each times a random number that stands for the place (multilinear hashing). A run of
words has a Rabin-Karp fingerprint: a polynomial modulo the prime 2**61 - 1, put together from runs
half as long. All random numbers follow from a key; callers whose answer rests on fingerprints alone
draw one for each query, so that no text can be made to collide.
"""

from __future__ import annotations

import ctypes
import gc
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperlake.session import partitions

U = np.uint64
SEGMENT = 1 << 20
CHUNK = 2 << 20
PRIME = U((1 << 61) - 1)
_GOLDEN = 0x9E3779B97F4A7C15


def _lut(separators: bytes, fold: bool) -> np.ndarray:
    table = np.arange(1, 257, dtype=np.uint16)
    if fold:
        table[65:91] = table[97:123]
    table[list(separators)] = 0
    return table


#: Words as they stand, cut at ASCII white space.
EXACT = _lut(b" \t\n\x0b\x0c\r", False)
#: ASCII letters in lower case, cut at ASCII white space, controls and punctuation.
FOLDED = _lut(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)), True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, by: int) -> np.ndarray:
    """Products with one number modulo 2**61 - 1; both are below it."""
    low, high = U(by & 0x7FFFFFFF), U(by >> 31)
    a0, a1 = a & U(0x7FFFFFFF), a >> U(31)
    middle = a1 * low + a0 * high
    return _fold(((a1 * high) << U(1)) + (middle >> U(30)) + ((middle & U(0x3FFFFFFF)) << U(31)) + a0 * low)


class Key:
    """The random numbers of one key: of bytes, of places in a word, and the bases of polynomials."""

    def __init__(self, key: int):
        self.seed = U(int(mix(np.array([key ^ 0x5851F42D4C957F2D], U))[0]))
        #: 0 is a separator's value and counts nothing
        self.byte = np.r_[U(0), self._series(1, 256)]
        self.place = self._series(1 << 20, 256)
        self.bases = tuple(int(x) % (int(PRIME) - 2) + 2 for x in self._series(2000, 2))

    def _series(self, first: int, n: int) -> np.ndarray:
        return mix((np.arange(first, first + n, dtype=U) + U(1)) * U(_GOLDEN) ^ self.seed)

    def places(self, n: int) -> np.ndarray:
        if len(self.place) < n:
            self.place = self._series(1 << 20, max(n, 2 * len(self.place)))
        return self.place

    def prints(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of values[start:end], runs that follow each other without overlap; values are bytes plus one."""
        size = end - start
        total = np.zeros(int(size.sum()) + 1, U)
        border = np.r_[0, np.cumsum(size)]
        place = np.arange(border[-1]) - np.repeat(border[:-1], size)
        inside = values if border[-1] == len(values) else values[np.repeat(start, size) + place]
        np.cumsum(self.byte[inside] * self.places(int(size.max(initial=0)))[place], out=total[1:])
        return mix(total[border[1:]] - total[border[:-1]])


_keys: dict[int, Key] = {}


def key_of(key: int) -> Key:
    if key not in _keys:
        if len(_keys) > 8:
            _keys.clear()
        _keys[key] = Key(key)
    return _keys[key]


def fresh_key() -> int:
    """A key that nobody knows beforehand; drawn on the driver, so that a task that runs again has the same one."""
    return secrets.randbits(62)


_held: list[dict] = []
#: glibc's; other systems do without
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def sole(cache: dict) -> dict:
    """A cache that a worker keeps between tasks; those of other operators go, since the worker serves one after another."""
    for other in _held:
        if other is not cache:
            other.clear()
    if not any(other is cache for other in _held):
        give_back()
    _held[:] = [cache]
    return cache


def give_back() -> None:
    """Memory that is free but held by the allocators goes back to the system: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run):
    """A task's function over batches that gives memory back when it ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of some rows: start and end byte, 64-bit fingerprint, row number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lut: np.ndarray = EXACT, key: int = 0):
        self.key = key_of(key)
        lo, hi = int(offsets[0]), int(offsets[-1])
        starts, ends, prints = [], [], []
        at = lo
        while at < hi:
            stop = min(hi, at + SEGMENT)
            if stop < hi:  # not inside a word
                back = np.flatnonzero(lut[data[at:stop]] == 0)
                if len(back):
                    stop = at + int(back[-1]) + 1
                else:
                    while stop < hi:
                        gap = np.flatnonzero(lut[data[stop : stop + SEGMENT]] == 0)
                        if len(gap):
                            stop += int(gap[0])
                            break
                        stop = min(hi, stop + SEGMENT)
            s, e, h = self._segment(lut[data[at:stop]], offsets[(offsets > at) & (offsets < stop)] - at)
            starts.append(s + at)
            ends.append(e + at)
            prints.append(h)
            at = stop
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.start, self.end, self.print = cat(starts, np.int64), cat(ends, np.int64), cat(prints, U)
        self.row = np.searchsorted(offsets, self.start, "right") - 1 if len(self.start) else np.zeros(0, np.int64)
        #: words of row r are first[r] to first[r + 1]
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))

    def _segment(self, values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(values)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = values != 0
        begins = inside[1:-1] & ~inside[:-2]
        stops = inside[1:-1] & ~inside[2:]
        if len(cuts):
            begins[cuts] |= inside[1:-1][cuts]
            stops[cuts - 1] |= inside[1:-1][cuts - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return s, e, self.key.prints(values, s, e)

    def windows(self, width: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of every run of `width` words inside a row; `base` tells independent fingerprints apart."""
        n = len(self.print) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        b = self.key.bases[base]
        half, size, out, done = _fold(self.print >> U(3)), 1, None, 0
        while True:
            if width & size:
                out = half if out is None else _fold(times(out[: len(half) - done], pow(b, size, int(PRIME))) + half[done:])
                done += size
            if done == width:
                break
            half = _fold(times(half[: len(half) - size], pow(b, size, int(PRIME))) + half[size:])
            size *= 2
        at = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        return at, mix(out[at])


def words(column: pa.Array, lut: np.ndarray = EXACT, limit: int = CHUNK, key: int = 0) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """(first row, end row, Words, bytes) for runs of rows, in order."""
    data, offsets = buffers(column)
    for i, j in chunks(offsets, limit):
        yield i, j, Words(data, offsets[i : j + 1], lut, key), data


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def groups_of(df: DataFrame, target: int) -> int:
    """Number of groups for a shuffle of about the size of `df` in files, of `target` bytes each; grows with the data.

    Where the size isn't known (Spark's default is beyond any real one), the session's shuffle partitions decide.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(16, partitions(df.sparkSession), size // target if size < 1 << 56 else 0)


def filter_rows(docs: DataFrame, run) -> DataFrame:
    """Rows of `docs` that `run` lets through; columns go by number meanwhile, so that any names will do."""
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
