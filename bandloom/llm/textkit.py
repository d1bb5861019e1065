"""Array kernels over batches of UTF-8 texts: slicing, tokens, 64-bit hashes, segment sums."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, U64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Not in a word of digits, ASCII letters and anything beyond ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x41:0x5B] = NOT_ALNUM[0x61:0x7B] = False
NOT_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def slices(column, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole rows of about ``limit`` bytes."""
    data, off = column_bytes(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte capitals U+00C0 to U+00DE in lower case; lengths stay."""
    low = LOWER[data]
    if len(low) > 1:
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        b = low[second]
        low[second] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 0x20, b)
    return low


def tokens(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that aren't separators; runs end with their row."""
    n = len(data)
    word = ~separators[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        out = np.full(max(n, 256), _MULT, U64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _POW = out
    return _POW


def exclusive(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span data[start:end]."""
    if not len(start):
        return np.zeros(0, U64)
    length = end - start
    first = exclusive(length)
    total = int(length.sum())
    step = np.arange(total)
    place = step - np.repeat(first, length)
    value = data[place + np.repeat(start, length)].astype(U64)
    value += U64(1)
    value *= powers(int(length.max()))[place]
    return mix(np.add.reduceat(value, first) ^ (length.astype(U64) * U64(0xD6E8FEB86659FD93)))


def segment_sum(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] along the first axis; consecutive segments, empty ones give 0."""
    out = np.zeros((len(start), *values.shape[1:]), values.dtype if values.dtype != bool else np.int64)
    full = np.flatnonzero(end > start)
    if len(full):
        lo, hi = start[full[0]], end[full[-1]]
        out[full] = np.add.reduceat(values[:hi], start[full], axis=0, dtype=out.dtype) if lo >= 0 else 0
    return out


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidied(f):
    """f, a function of an iterator of batches; at its end, freed memory goes back to the system.

    Python workers live on from task to task, beside the next one's memory.
    """

    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return run


def columns(batch: pa.RecordBatch, *names: str) -> list:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]
