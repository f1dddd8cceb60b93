"""Texts of an Arrow batch as flat numpy arrays: words, hashes and document bounds.

Everything here works on whole texts. A batch is cut into pieces of about
`PIECE` bytes at document bounds, so that temporary arrays stay small however
many rows a batch holds; one text longer than that is a piece of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Gives freed memory back to the system: a worker is kept for later stages, and so would its largest size be."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def releasing(run: Callable) -> Callable:
    """A kernel over Arrow batches that gives its memory back at its end."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return kernel


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + PIECE // 8), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 4 * PIECE:
            _powers[kind] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base**position before every position (length n + 1)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], alike for equal bytes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _power("down", _BASE_INV, len(sums))[starts])


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every window of `width` bytes, by start."""
    n = max(len(sums) - width, 0)
    return mix((sums[width:] - sums[:n]) * _power("down", _BASE_INV, len(sums))[:n])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one text after another, and n + 1 bounds; null: empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) of consecutive rows of about `size` bytes."""
    yield from cut(*text_bytes(column), size)


def cut(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """`pieces` of texts that are bytes and bounds already."""
    row, n = 0, len(bounds) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1)
        yield row, to, data[bounds[row] : bounds[to]], bounds[row : to + 1] - bounds[row]
        row = to


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z: row, start, end and hash of each, in text order."""
    data = _LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    word = ~_SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~word[:-1]
    after[:-1] = ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    rows = np.searchsorted(bounds, starts, "right") - 1
    return rows, starts, ends, span_hashes(prefix_hashes(data), starts, ends)


def shingles(rows: np.ndarray, hashes: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct `width`-word shingles (a shorter row's words as one): row and hash, by row, then hash."""
    if not len(rows):
        return rows, hashes
    counts = np.bincount(rows, minlength=n_rows)
    firsts = np.concatenate(([0], np.cumsum(counts)))
    short = np.flatnonzero((counts > 0) & (counts < width))
    last = firsts[rows] + counts[rows] - width
    full = np.flatnonzero(np.arange(len(rows)) <= last)
    h = np.full(len(full), width, np.uint64)
    for j in range(width):
        h = mix(h * _BASE + hashes[full + j])
    more = np.zeros(len(short), np.uint64)
    for k, r in enumerate(short.tolist()):
        x = np.full(1, counts[r], np.uint64)
        for j in range(firsts[r], firsts[r + 1]):
            x = mix(x * _BASE + hashes[j : j + 1])
        more[k] = x[0]
    h, r = np.concatenate((h, more)), np.concatenate((rows[full], short))
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]
