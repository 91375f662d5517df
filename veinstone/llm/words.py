"""Vectorised words and hashes of whole texts, straight from Arrow's string buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit polynomial sums over the
word's bytes, mixed; they depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        steps = np.full(size, np.uint64(base))
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * CHUNK:
            _POWERS[base] = have
    return have[:n]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about limit bytes. A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(start + 1, stop))
        lo, hi = int(offsets[start]), int(offsets[stop])
        yield start, stop, buf[lo:hi], offsets[start : stop + 1] - lo
        start = stop


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte, end byte) of each word of the rows that offsets cut buf into."""
    n, rows = len(buf), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    inside = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    first = np.flatnonzero(inside & (before | edge[:n]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[buf] * _powers(_BASE, n), out=sums[1:])
    hashes = mix64((sums[end] - sums[first]) * _powers(_INVERSE, n)[first])
    row = np.repeat(np.arange(rows), np.diff(np.searchsorted(first, offsets)))
    return hashes, row, first, end


def spans(buf: np.ndarray, first: np.ndarray, end: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Hashes of buf[first:end]; where opens, of a space and that."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(_BASE, len(buf)), out=sums[1:])
    hashes = (sums[end] - sums[first]) * _powers(_INVERSE, len(buf))[first]
    return mix64(np.where(opens, hashes * np.uint64(_BASE) + _BYTE[0x20], hashes))


def shingles(hashes: np.ndarray, row: np.ndarray, k: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index of the first word) of runs of k words inside a row; a row of 1 to k - 1 words is one run."""
    n = len(hashes)
    if not n:
        return hashes, row, row
    total = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        total += hashes[j : n - k + 1 + j] * _ODD[j] if n >= k else total
    good = np.flatnonzero(row[: n - k + 1] == row[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    out, at = [mix64(total[good])], [good]
    counts = np.bincount(row, minlength=rows)
    starts = np.cumsum(counts) - counts
    for size in range(1, k):
        some = starts[counts == size]
        if len(some):
            short = np.full(len(some), np.uint64(size * _BASE % (1 << 64)))
            for j in range(size):
                short += hashes[some + j] * _ODD[j]
            out.append(mix64(short))
            at.append(some)
    where = np.concatenate(at)
    return np.concatenate(out), row[where], where


def distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, sorted by row, then hash."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[keep], row[keep]
