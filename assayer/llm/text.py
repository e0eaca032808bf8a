"""Tokens and shingles of whole Arrow batches as 64-bit hashes, computed with numpy over the UTF-8 bytes.

A batch is cut into groups of documents of about `CHUNK` bytes, so the working memory follows the longest
document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_SEED = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_WHITE = [9, 10, 11, 12, 13, 32]
#: Class of each byte: 0 separates, others form tokens of one class.
BY_SPACE = np.ones(256, dtype=np.uint8)
BY_SPACE[_WHITE] = 0
_ALNUM = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
BY_LETTERS = np.zeros(256, dtype=np.uint8)
BY_LETTERS[_ALNUM] = 1
BY_RUNS = np.full(256, 2, dtype=np.uint8)
BY_RUNS[_ALNUM] = 1
BY_RUNS[_WHITE] = 0


class _Powers:
    """Powers of an odd number modulo 2**64, grown as longer texts come."""

    def __init__(self, base: int):
        self.base, self.have = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.have) < n:
            step = np.full(max(n, 2 * len(self.have)), self.base, dtype=np.uint64)
            step[0] = 1
            self.have = np.cumprod(step)
        return self.have[:n]


_UP, _DOWN = _Powers(_P), _Powers(_P_INV)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def tokens(column: pa.Array, classes: np.ndarray, beginnings: tuple[int, ...] = ()) -> Iterator[tuple]:
    """For consecutive groups of rows: first row, end row, hash of each token, and the bounds of each row's tokens.

    beginnings: also a list of the hashes of each token's first so many bytes.
    """
    data, offsets = utf8(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        yield (first, end, *_hashed(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], classes, beginnings))
        first = end


def _hashed(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, beginnings: tuple[int, ...]) -> tuple:
    size = len(data)
    if not size:
        none = np.zeros(0, np.uint64)
        return (none, np.zeros(len(offsets), np.int64), *([[none] * len(beginnings)] if beginnings else []))
    cls = classes[data]
    change = np.empty(size + 1, dtype=bool)
    np.not_equal(cls[1:], cls[:-1], out=change[1:size])
    change[0] = change[size] = True
    change[offsets] = True
    edges = np.flatnonzero(change)
    inside = cls[edges[:-1]] != 0
    start, stop = edges[:-1][inside], edges[1:][inside]
    run = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_SEED[FOLD[data]] * _UP.upto(size), out=run[1:])
    down = _DOWN.upto(size)[start]
    of = lambda end: mix((run[end] - run[start]) * down + (end - start).astype(np.uint64))
    return (of(stop), np.searchsorted(start, offsets), *([[of(np.minimum(stop, start + k)) for k in beginnings]] if beginnings else []))


def shingles(value: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every `width`-token shingle in order, and each row's bounds. A row with fewer tokens has one, of all its tokens."""
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    ends = np.concatenate(([0], np.cumsum(made)))
    row = np.repeat(np.arange(len(counts)), made)
    at = np.arange(ends[-1]) - ends[row] + bounds[row]
    have = np.minimum(counts, width)[row]
    total = have.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    padded = np.concatenate((value, np.zeros(width, np.uint64)))
    for k in range(width):
        part = padded[at + k] * _U(pow(0xA0761D6478BD642F, k + 1, 1 << 64))
        total = total + (part if counts.size and counts.min() >= width else np.where(k < have, part, _U(0)))
    return mix(total), ends


def distinct(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row."""
    value = value.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        value[a:b].sort()
    first = np.ones(len(value), dtype=bool)
    first[1:] = value[1:] != value[:-1]
    first[bounds[:-1][bounds[:-1] < len(value)]] = True
    return value[first], np.concatenate(([0], np.cumsum(first)))[bounds]
