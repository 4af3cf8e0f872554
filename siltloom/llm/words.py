"""Vectorised word tables over Arrow string columns, shared by the numpy-backed operators.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 are the words
``[^\\x20\\x09-\\x0D]+`` of the text. Hashes are 64-bit; two different words of one document share
one with a chance of about 2**-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), BASE, np.uint64))
    return _powers


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if data is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold up to ``limit`` bytes together, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of true bytes; runs don't cross rows."""
    n = len(is_word)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = is_word[edges]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = is_word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, is_word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    at = np.zeros(len(data), np.int64)
    at[starts] = starts
    np.maximum.accumulate(at, out=at)
    at = np.arange(len(data), dtype=np.int64) - at
    longest = int((ends - starts).max()) + 1
    np.minimum(at, longest, out=at)
    values = BYTE[data]
    values *= powers(longest + 1)[at]
    values[~is_word] = 0
    return mix(np.add.reduceat(values, starts) + (ends - starts).astype(np.uint64))
