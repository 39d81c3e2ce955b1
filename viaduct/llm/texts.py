"""Byte-level helpers for Arrow batches of texts: chunks of whole texts as one byte array, word and shingle hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: So many powers at most are kept between calls, as Python workers are used again by later stages.
_KEPT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit word for each byte value.
BYTE_WORDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; up to _KEPT of them are kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        _powers[base] = have[:_KEPT].copy() if n > _KEPT else have
    return have[:n]


def chunks(column: pa.Array, limit: int = 1 << 21):
    """(first row, row after the last, bytes, offsets of the rows in them): whole texts, about limit bytes at a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(len(column), max(lo + 1, hi))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] the polynomial hash of bytes i to j, times base^i."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_WORDS[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def slice_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes that are inside words begin and end; runs end with their row."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[row_starts] = inside[row_starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[row_starts[1:] - 1] = inside[row_starts[1:] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all rows, in order, and the number of words of each row."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    if len(data) > 2 * PIECE and len(offsets) > 2:  # rows in pieces, to keep the arrays small
        cuts = np.unique(np.searchsorted(offsets, np.arange(0, len(data), PIECE)))
        cuts = np.unique(np.append(cuts[cuts < len(offsets) - 1], [0, len(offsets) - 1]))
        parts = [words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)] if len(cuts) > 2 else []
        if parts:
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    start, end = word_spans(data, offsets, ~_SPACE[data])
    hashes = slice_hashes(prefix_hashes(_LOWER[data] if lower else data), start, end)
    return hashes, np.diff(np.searchsorted(start, offsets))


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of n words within a row; a row of 1 to n-1 words has one shingle of all of them."""
    total = len(hashes)
    rows = np.repeat(np.arange(len(counts)), counts)
    begins = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(total) - begins[:-1][rows]
    out = np.zeros(total, dtype=np.uint64)
    for k in range(n):
        part = np.zeros(total, dtype=np.uint64)
        part[: total - k] = hashes[k:] if k else hashes
        beyond = place + k >= counts[rows]
        part[beyond] = 0
        out = mix(out * np.uint64(_BASE) + part + np.uint64(k))
    keep = (place == 0) | (place + n <= counts[rows])
    return rows[keep], out[keep]


def multiset(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in order of row and hash, with how often each occurs."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return r[at], h[at], np.diff(np.append(at, len(r)))
