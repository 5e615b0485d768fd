"""Vectorised helpers on Arrow string columns: tokens, hashes and byte windows.

All of them work on the UTF-8 buffers of a batch, in pieces of bounded size, so that a batch with a
very long text needs little more memory than the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes looked at together.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROLL = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_ROLL_LOWER = _ROLL[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix()."""
    x = x ^ (x >> U64(31)) ^ (x >> U64(62))
    x = x * U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> U64(27)) ^ (x >> U64(54))
    x = x * U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def rolling(b: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums c such that (c[j] - c[i]) * inverse**i is the hash of bytes i to j."""
    c = np.empty(len(b) + 1, U64)
    c[0] = 0
    x = (_ROLL_LOWER if lower else _ROLL)[b]
    x *= powers(len(b) + 1)[0][: len(b)]
    np.cumsum(x, out=c[1:])
    return c


def spans_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), by rolling()'s sums; the length counts."""
    return mix((c[end] - c[start]) * powers(len(c))[1][start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data, offsets


def runs(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive documents [i, j) with at most limit bytes, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _piece(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of b, and its rolling sums; first: where documents begin."""
    space = _SPACE[b]
    edge = np.empty(len(b) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = space[:-1]
    before = edge[:-1].copy()
    before[first[first < len(b)]] = True
    start = np.flatnonzero(before & ~space)
    after = np.empty(len(b), bool)
    after[-1] = True
    after[:-1] = space[1:] | before[1:]
    return start, np.flatnonzero(after & ~space) + 1, rolling(b, True)


def word_hashes(column: pa.Array, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(i, j, counts, hashes): of all words of documents i to j their number by document, their hashes,
    and the hashes of their first bytes, as many as each of prefixes says (or all).

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
    return; A-Z count as a-z. A document is never split over two results.
    """
    data, offsets = buffers(column)

    def of(start: np.ndarray, end: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
        return [spans_hash(c, start, end), *(spans_hash(c, start, np.minimum(start + k, end)) for k in prefixes)]

    for i, j in runs(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi == lo:
            yield i, j, np.zeros(j - i, np.int64), [np.zeros(0, U64)] * (1 + len(prefixes))
        elif hi - lo <= PIECE:
            first = offsets[i : j + 1] - lo
            start, end, c = _piece(data[lo:hi], first[:-1])
            yield i, j, np.diff(np.searchsorted(start, first)), of(start, end, c)
        else:
            parts = [of(*x) for x in _long_pieces(data[lo:hi])]
            yield i, j, np.array([sum(len(x[0]) for x in parts)]), [np.concatenate(x) for x in zip(*parts, strict=True)]


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As word_hashes(), with the hashes of whole words only."""
    for i, j, n, (h,) in word_hashes(column):
        yield i, j, n, h


def _long_pieces(b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """_piece() of one long text, cut where a word ends."""
    at = 0
    while at < len(b):
        end = min(at + PIECE, len(b))
        if end < len(b):
            back = np.flatnonzero(_SPACE[b[at:end]])
            while not len(back) and end < len(b):
                far = min(end + PIECE, len(b))
                back = np.flatnonzero(_SPACE[b[end:far]]) + (end - at)
                end = far if not len(back) else end
            if len(back):
                end = at + int(back[-1]) + 1
        yield _piece(b[at:end], np.zeros(1, np.int64))
        at = end
