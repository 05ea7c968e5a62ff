"""Vectorised word handling over Arrow text columns.

A batch of texts is one byte buffer with row offsets.  Word boundaries and 64-bit word hashes
are found with numpy operations over blocks of ``CHUNK`` bytes; there is no loop over words.  Memory
is about 60 times a block, and some 16 bytes for each word of the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: What a byte's place in its word adds to its value before both are mixed.
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the words of a shingle, by place.
PLACE = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)

#: Separators of the contract's words: space and the controls 09 to 0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of plain words: everything in ASCII that is neither letter nor digit.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Mixed values of all bytes in the first places, which most words don't go beyond.
_NEAR = 64
_TABLE = mix(_BYTE[None, :] + np.arange(_NEAR, dtype=np.uint64)[:, None] * _STEP).ravel()


def run_hashes(data: np.ndarray, begins: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sums over runs of bytes, which lie on end and begin at ``begins``, of a mixed value of each
    byte and its place.

    A byte's value at one place tells nothing about that at another, so no pattern of bytes makes
    runs alike (sums of powers of a base do that, whatever the base).
    """
    values = _TABLE.take(np.minimum(place, _NEAR - 1) * 256 + data)
    if len(place) and place.max() >= _NEAR:
        far = np.flatnonzero(place >= _NEAR)
        values[far] = mix(_BYTE[data[far]] + place[far].astype(np.uint64) * _STEP)
    return np.add.reduceat(values, begins) if len(begins) else np.zeros(0, np.uint64)


def places(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of these lengths begin when they lie on end, and each byte's place in its run."""
    begins = np.cumsum(length) - length
    return begins, np.arange(int(length.sum()), dtype=np.int32) - np.repeat(begins.astype(np.int32), length)


def finished(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of runs from their sums and lengths."""
    return mix(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    n, (_, offsets, data) = len(column), column.buffers()
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``CHUNK`` bytes, one row at least."""
    n, lo, size = len(offsets) - 1, 0, CHUNK
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def runs(data: np.ndarray, edge: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of visible bytes in a block, and which bytes those are; ``edge``
    marks where a row begins (one more entry than bytes)."""
    inside = ~apart[data]
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | edge[1:-1])))
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:] | edge[1:-1], [True]))) + 1
    return starts, ends, inside


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some rows in order, and per row the number of its first word (one
    more entry than rows).  ASCII capitals count as small letters.

    Blocks cut through words: places in the second part of such a word go on from the first, and
    their sums add up, so its hash does not depend on where blocks end.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begin, raw, size = [], [], []
    for lo in range(0, len(data), CHUNK):
        hi = min(lo + CHUNK, len(data))
        edge = np.zeros(hi - lo + 1, bool)
        edge[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo] = True
        starts, ends, inside = runs(data[lo:hi], edge, apart)
        length = ends - starts
        begins, place = places(length)
        goes_on = bool(len(starts) and starts[0] == 0 and not edge[0] and size and len(size[-1]) and begin[-1][-1] + size[-1][-1] == lo)
        if goes_on:
            place = place.astype(np.int64)
            place[: length[0]] += size[-1][-1]
        hashes = run_hashes(_LOWER[data[lo:hi][inside]], begins, place)
        if goes_on:
            raw[-1][-1:] += hashes[:1]
            size[-1][-1] += length[0]
            starts, hashes, length = starts[1:], hashes[1:], length[1:]
        if len(starts) or not size:
            begin.append(starts + lo)
            raw.append(hashes)
            size.append(length)
    first, lengths = np.concatenate(begin), np.concatenate(size)
    return finished(np.concatenate(raw), lengths), np.searchsorted(first, offsets)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a row, with their rows; a row with fewer
    words (one at least) has its whole sequence as one shingle."""
    count = np.diff(first)
    row = rows_of(first)
    out, rows = [], []
    if len(hashes) >= width:
        ok = row[: len(hashes) - width + 1] == row[width - 1 :]
        h = np.zeros(len(hashes) - width + 1, np.uint64)
        for k in range(width):
            h += hashes[k : len(hashes) - width + 1 + k] * PLACE[k]
        out.append(mix(h[ok] + np.uint64(width)))
        rows.append(row[: len(hashes) - width + 1][ok])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            h[has] += hashes[first[short[has]] + k] * PLACE[k]
        out.append(mix(h + count[short].astype(np.uint64)))
        rows.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(out), np.concatenate(rows)
    order = np.argsort(r, kind="stable")
    return h[order], r[order]
