"""Vectorised word splitting and hashing over the buffers of Arrow string columns.

Words are maximal runs of bytes other than ASCII white space, case kept.  A word's
hash is a polynomial over its bytes in arithmetic modulo 2**64, so that all words of a
block come out of one running sum; only words of more than LONG_WORD bytes are hashed one
by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
#: Longer words are hashed by BLAKE2b: a polynomial modulo 2**64 has known collisions among long words of two letters.
LONG_WORD = 256
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240613).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_TOO = np.random.default_rng(20240614).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        pair = []
        for base in (_P, _P_INV):
            column = np.full(n, base, dtype=np.uint64)
            column[0] = 1
            pair.append(np.multiply.accumulate(column))
        _powers = (pair[0], pair[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The values of x once each, sorted; np.unique would hash them, which takes several times as long where most differ."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and the bytes they point into; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def blocks(at: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold up to `limit` bytes each; a longer row is a range of its own."""
    low, n = 0, len(at) - 1
    while low < n:
        high = int(np.searchsorted(at, at[low] + limit, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


def spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of `data`; no word crosses a cut (sorted offsets)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none
    space = _SPACE[data]
    head = np.empty(n, dtype=bool)
    head[0] = True
    head[1:] = space[:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    head[inner] = True
    starts = np.flatnonzero(head & ~space)
    tail = np.empty(n, dtype=bool)
    tail[-1] = True
    tail[:-1] = space[1:]
    tail[inner - 1] = True
    return starts, np.flatnonzero(tail & ~space) + 1


def words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of `data` and the hashes of their words."""
    starts, ends = spans(data, cuts)
    return starts, ends, hashed(data, starts, ends, _BYTE, 0)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte: np.ndarray, half: int) -> np.ndarray:
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte[data] * power[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()[8 * half : 8 * half + 8], "little")
    return hashes


def other_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the same words that don't depend on those of `words`; both together tell words apart by 128 bits."""
    return hashed(data, starts, ends, _BYTE_TOO, 1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within each row, and the rows' bounds among them.

    bounds: offsets of the rows' words.  A row of fewer than n words, but at least one,
    has a single shingle made of all its words.
    """
    count = np.diff(bounds)
    if n == 1:
        return mix(hashes[bounds[0] : bounds[-1]] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(2)), np.append(0, np.cumsum(count)).astype(np.int64)
    rows = len(count)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    out = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    row = np.repeat(np.arange(rows), made)
    first = bounds[:-1][row] + (np.arange(out[-1]) - out[:-1][row])
    width = np.minimum(count[row], n)
    power, _ = powers(len(hashes) + 1)
    spread = hashes * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    h = np.zeros(out[-1], dtype=np.uint64)
    for k in range(n):
        inside = k < width
        if inside.all():
            h = h * _P + spread[first + k]
        else:
            h = np.where(inside, h * _P + spread[np.minimum(first + k, len(hashes) - 1)], h)
    return mix(h + width.astype(np.uint64)), out
