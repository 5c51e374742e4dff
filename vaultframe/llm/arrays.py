"""Array helpers for tasks: texts as byte arrays, words, hashes. Everything works on one Arrow batch at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on by itself.
SLICE = 1 << 20
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the input reaches each bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the n + 1 offsets; null is empty."""
    column = (pc.fill_null(column, "") if column.null_count else column).cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def give_back() -> None:
    """Memory that this process holds but no longer uses goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(per_batch: Callable) -> Callable:
    """per_batch, after which a worker gives back memory: workers outlive their tasks."""

    @wraps(per_batch)
    def run(batches):
        yield from per_batch(batches)
        give_back()

    return run


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Hashes of any byte ranges of one array, from running sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(20, (max(1, len(data)) - 1).bit_length())
        self.up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        term = data.astype(np.uint64)
        term += np.uint64(1)
        term *= self.up[: len(data)]
        np.cumsum(term, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _M2)

    def runs(self, size: int) -> np.ndarray:
        """Hash of each `size` consecutive bytes; as of() gives it."""
        n = max(0, len(self.sums) - size)
        x = self.sums[size:] - self.sums[:n]
        x *= self.down[:n]
        x += np.array([size], np.uint64) * _M2
        return mix(x)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and row of each word [^\\x20\\x09-\\x0D]+; words do not cross rows."""
    inside = ~_SEPARATOR[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[filled] = False
    after[filled[1:] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def runs_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _M1 + values[k : k + n]
    return mix(total)


def shingles(words: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of `size` words; a row of fewer words has one run of all of them."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    full = runs_hash(words, size)
    whole = row[: len(full)] == row[size - 1 :] if len(full) else np.zeros(0, bool)
    hashes, owner = [full[whole]], [row[: len(full)][whole]]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        total = np.full(len(short), n, np.uint64)
        for k in range(n):
            total = total * _M1 + words[first[short] + k]
        hashes.append(mix(total))
        owner.append(short)
    return np.concatenate(hashes), np.concatenate(owner)


def distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row), sorted by row and then hash, with their counts."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return h[at], r[at], np.diff(np.append(at, len(h)))


def listed(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """Values grouped by (sorted) row as an Arrow list column."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
