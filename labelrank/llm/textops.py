"""Numpy helpers that work on the UTF-8 bytes of many documents at once, straight from Arrow buffers.

A slice is a run of rows of an Arrow batch whose texts lie back to back in one byte array, so that words
and shingles of many short documents cost a few array operations, and a long document is a slice by itself.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes after which a slice ends; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes every output bit."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h = h ^ (h >> _U(27))
    h = h * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


class _Powers:
    """Powers of a number modulo 2**64: those of an ordinary slice are kept, those of a longer text are not."""

    def __init__(self, base: np.uint64):
        self.base, self.all = base, np.ones(1, np.uint64)

    def _first(self, n: int) -> np.ndarray:
        steps = np.full(n, self.base, np.uint64)
        steps[:1] = 1
        return np.cumprod(steps, out=steps)

    def upto(self, n: int) -> np.ndarray:
        if n > SLICE_BYTES + 1:
            return self._first(n)
        if len(self.all) < n:
            self.all = self._first(SLICE_BYTES + 1)
        return self.all[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_BASE_INVERSE)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task function ``run``, which at its end gives freed memory back to the system.

    Workers live on for the tasks of later stages; without this, what one stage has freed stays with its worker,
    beside the memory that the next stage takes in the executor.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return task


def text_array(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column with null as the empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.fill_null("") if col.null_count else col


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts): starts has one entry more than rows and begins with 0."""
    n = len(texts)
    if not n:
        return
    wide = 8 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else 4
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide == 8 else np.int32, n + 1, texts.offset * wide).astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, per document the number of the first word, with one entry more than documents)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cut = starts[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut + 1] & inside[cut]]  # a document that ends within a word of the joined bytes
    begins[cut] = True
    ends[cut] = True
    begin, end = np.flatnonzero(begins[:-1]), np.flatnonzero(ends)
    return begin, end, np.searchsorted(begin, starts)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which range_hash takes the hash of any range."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _DOWN.upto(len(data)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from begin to end, the same wherever they stand."""
    return mix((sums[end] - sums[begin]) * _UP.upto(len(sums))[begin] + (end - begin).astype(np.uint64))


def shingles(data: np.ndarray, starts: np.ndarray, width: int, lower: bool = True) -> list[np.ndarray]:
    """Per document the sorted distinct 64-bit hashes of its runs of ``width`` words.

    A document with fewer words, but at least one, has one shingle of all its words; others have none.
    """
    hashes, first = shingle_runs(data, starts, width, lower)
    return [np.unique(hashes[first[i] : first[i + 1]]) for i in range(len(starts) - 1)]


def shingle_runs(
    data: np.ndarray, starts: np.ndarray, width: int, lower: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes in text order, and per document where they begin (one entry more than documents)."""
    data = LOWER[data] if lower else data
    begin, end, first = words(data, starts)
    word = range_hash(prefix_hash(data), begin, end)
    total = len(word)
    at = np.diff(first)
    counts = np.where(at >= width, at - width + 1, np.minimum(at, 1))
    out_first = np.concatenate([[0], np.cumsum(counts)])
    if not total:
        return np.zeros(0, np.uint64), out_first
    run = np.zeros(total, np.uint64)
    for k in range(min(width, total)):
        run[: total - k] = run[: total - k] * _U(0xA24BAED4963EE407) + word[k:]
    run = mix(run + _U(width))
    keep = np.zeros(total, bool)
    for i in np.flatnonzero((at > 0) & (at < width)):  # short documents: one hash of the whole sequence
        h = _U(0)
        with np.errstate(over="ignore"):
            for w in word[first[i] : first[i + 1]]:
                h = h * _U(0xA24BAED4963EE407) + w
            run[first[i]] = mix(np.array([h + _U(at[i])]))[0]
        keep[first[i]] = True
    room = np.repeat(first[1:], at) - np.arange(total)
    keep |= room >= width
    return run[keep], out_first
