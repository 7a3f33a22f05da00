"""Vectorised words and hashes over Arrow string columns.

A word is a maximal run of bytes outside the ASCII white space set (0x20, 0x09-0x0D); in UTF-8 this is the
regular expression ``[^\\x20\\x09-\\x0D]+`` over code points. Words are hashed to 64 bits without building
Python strings: a polynomial hash over the whole buffer gives every word as a difference of two prefix sums.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at once; it bounds a Python worker's memory, unless one text alone is longer.
SLICE_BYTES = 1 << 18

_RADIX = 0x9E3779B97F4A7C15
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _radix_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_RADIX, pow(_RADIX, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a column: row, byte range in ``data`` and hash of each; ``bounds`` are the rows' byte offsets."""

    data: np.ndarray
    bounds: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    sums: np.ndarray

    def rehash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of other byte ranges."""
        return mix((self.sums[end] - self.sums[start]) * _powers[1][start] + (end - start).astype(np.uint64))

    @property
    def first(self) -> np.ndarray:
        """For each row, the index of its first word; one more entry closes the last row."""
        return np.searchsorted(self.row, np.arange(len(self.bounds)))

    def string(self, k: int) -> str:
        return self.data[self.start[k] : self.end[k]].tobytes().decode("utf-8", "replace")


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, joined, and the offsets of each value; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def words(col: pa.Array, lower: bool = False) -> Words:
    """Words of each value of col, in order; lower: A-Z as a-z."""
    data, bounds = buffer_of(col)
    if lower:
        data = _LOWER[data]
    n = len(data)
    ink = ~_SPACE[data]
    opens = ink.copy()
    opens[1:] &= ~ink[:-1]
    inner = bounds[:-1][bounds[:-1] < n]
    opens[inner] = ink[inner]
    closes = ink.copy()
    closes[:-1] &= ~ink[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    closes[last] = ink[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _radix_powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(data, bounds, np.searchsorted(bounds, start, side="right") - 1, start, end, h, sums)


_kept: dict = {}


def kept_for_stage(key, make: Callable):
    """make(), once for a worker process and stage. The worker drops it at the first task of another stage."""
    _same_stage()
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _same_stage() -> None:
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if _kept.get("stage", stage) != stage:
        _kept.clear()
    _kept["stage"] = stage


def _trim() -> None:
    """Give free memory back, as a worker process outlives its task and waits for others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose values in column hold about limit bytes, one row at least."""
    _same_stage()
    for batch in batches:
        k = batch.schema.get_field_index(column)
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(k)), 0), dtype=np.int64))
        at, n = 0, batch.num_rows
        while at < n:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    _trim()


def hash_of(texts: list[str]) -> np.ndarray:
    """The same hash as that of words, of whole strings."""
    out = []
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        up, _ = _radix_powers(len(b) + 1)
        out.append(np.uint64(np.sum(_BYTE_CODES[b] * up[: len(b)], dtype=np.uint64)) + np.uint64(len(b)))
    return mix(np.array(out, np.uint64))


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash of a tuple of hashes; order counts."""
    out = np.full(len(parts[0]), 0x2545F4914F6CDD1D, np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + p)
    return out


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing) -> np.ndarray:
    """values at wanted, found in the sorted keys."""
    if not len(keys):
        return np.full(len(wanted), missing, values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)
