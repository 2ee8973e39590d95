"""Vectorised hashing of words and word shingles over batches of texts."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_BYTE_SEED = 20_240_611
_CHUNK = 1 << 18
#: Python functions take so many rows of an Arrow batch at once.
SLICE_ROWS = 512


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random odd-looking value for each byte; lower-cased variant beside it.
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_SEED))
_LOWER_VALUES = _VALUES.copy()
_LOWER_VALUES[65:91] = _VALUES[97:123]


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, _CHUNK)
            up, down = np.full(n, _MULTIPLIER, np.uint64), np.full(n, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, which may hold all texts of a task: what is made of
    them takes memory for one part at a time."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(at, SLICE_ROWS)


def give_back() -> None:
    """Return what this process's allocators keep but don't use: Python workers
    outlive their tasks, and later tasks run beside them or in them."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(raw: list[bytes], most: int = _CHUNK):
    """Slices of the list of about ``most`` bytes each; a longer text is a
    slice of its own."""
    start = size = 0
    for k, x in enumerate(raw):
        if size and size + len(x) > most:
            yield start, k
            start, size = k, 0
        size += len(x)
    if start < len(raw):
        yield start, len(raw)


class Ranges:
    """Polynomial hashes of ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers.get(len(values) + 2)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end) of ``data``."""
    return mix64(Ranges(values[data]).of(starts, ends) + (ends - starts).astype(np.uint64))


def word_hashes(raw: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's
    words start in them (one more entry than texts). Words are maximal runs
    of bytes other than 0x20 and 0x09-0x0D; ``lower`` folds A-Z."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    hashes = range_hashes(data, starts, ends, _LOWER_VALUES if lower else _VALUES)
    bounds = np.cumsum([0, *[len(x) + 1 for x in raw]])
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(raw: list[bytes], width: int = 5):
    """For each text, the sorted distinct hashes of its shingles of ``width``
    words; a text of fewer words has one shingle, one without words none."""
    factors = mix64(np.arange(11, 11 + width, dtype=np.uint64)) | np.uint64(1)
    for first, last in chunks(raw):
        words, bounds = word_hashes(raw[first:last])
        full = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for k in range(width):
            full += words[k : k + len(full)] * factors[k]
        full = mix64(full)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if e - s >= width:
                yield np.unique(full[s : e - width + 1])
            elif e > s:
                yield mix64((words[s:e] * factors[: e - s]).sum(dtype=np.uint64, keepdims=True) + np.uint64(e - s))
            else:
                yield np.empty(0, np.uint64)


def digest64(values: np.ndarray) -> int:
    """A signed 64-bit digest of an array."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)
