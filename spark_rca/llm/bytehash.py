"""Vectorised byte hashing shared by the text operators.

Texts of an Arrow batch are one byte buffer plus offsets, so words, k-grams and whole
fragments are hashed with prefix sums instead of per-row Python.  Hashes are 64-bit
polynomials over random byte codes, finished with a mixing step; equal strings always get
equal values and two different strings collide with a probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = CODES.copy()
LOWER[65:91] = CODES[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: The white space that separates words: blank and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 20), BASE if kind == "up" else BASE_INV, np.uint64)
        step[0] = 1
        have = _POWERS[kind] = np.multiply.accumulate(step)
    return have[:n]


def prefix(data: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """Prefix sums p with hash(data[a:b]) = span(p, a, b)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * _power("up", len(data)), out=out[1:])
    return out


def summed(codes: np.ndarray) -> np.ndarray:
    """The same for a sequence of 64-bit codes, such as hashes of words."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power("up", len(codes)), out=out[1:])
    return out


def span(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((p[b] - p[a]) * _power("down", len(p))[a] + (b - a).astype(np.uint64) * BASE)


def grams(p: np.ndarray, k: int) -> np.ndarray:
    """span(p, a, a + k) for every a."""
    n = len(p) - k
    return mix((p[k:] - p[:n]) * _power("down", len(p))[:n] + np.full(1, k, np.uint64) * BASE)


def batches(column: pa.ChunkedArray | pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``limit`` bytes; nulls are empty.

    A single longer text is a run of its own.
    """
    for arr in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        arr = arr.cast(pa.large_binary()).fill_null(b"")
        n, bufs = len(arr), arr.buffers()
        offs = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        row = 0
        while row < n:
            end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
            yield row, data[offs[row] : offs[end]], (offs[row : end + 1] - offs[row])
            row = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word."""
    ink = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.concatenate([[False], ink[:-1]]) if len(data) else ink
    starts = np.flatnonzero(ink & (~before | first[:-1]))
    after = np.concatenate([ink[1:], [False]]) if len(data) else ink
    ends = np.flatnonzero(ink & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)
