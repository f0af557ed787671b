"""Vectorised work on the text column of Arrow batches, shared by the operators that run in Python tasks.

Texts of a batch are one run of UTF-8 bytes with row bounds; words, lines and their hashes are found with NumPy over
those bytes, a bounded window at a time, so memory does not follow the length of a partition.

Words are ``[^\\x20\\x09-\\x0D]+``: the separators are ASCII, so byte positions decide them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
WINDOW = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n (kept, grown by doubling)."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        got = np.empty(size, np.uint64)
        got[0] = 1
        done, step = 1, base
        while done < size:
            got[done:2 * done] = got[:done] * np.uint64(step)
            step = step * step % (1 << 64)
            done *= 2
        _POWERS[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = int(bounds[0]) if len(bounds) else 0
    hi = int(bounds[-1]) if len(bounds) else 0
    return data[lo:hi], bounds - lo


def slices(batch: pa.RecordBatch, column: str, size: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes of text (one row at least)."""
    _, bounds = raw_text(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def runs(data: np.ndarray, bounds: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes that ``out`` (a table of 256 flags) does not mark; a run ends with
    its row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    skip = out[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, skip[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, skip[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    before[inner] = True
    after[inner - 1] = True
    return np.flatnonzero(~skip & before), np.flatnonzero(~skip & after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (ordered, not overlapping); equal bytes have equal hashes.

    Sums of random byte values times powers of an odd base, shifted back to the span's start, then mixed with the
    length; found from running sums over windows of whole spans.
    """
    got = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + WINDOW, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * powers(_BASE, b - a), out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        got[lo:hi] = (sums[e] - sums[s]) * powers(_INVERSE, b - a + 1)[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix(got)


def rows_of(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The row each position lies in."""
    return np.searchsorted(bounds, starts, side="right") - 1


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts (or exact integer sums below 2**53) of the entries of each row."""
    return np.bincount(rows, weights, minlength=n).astype(np.int64)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words of a row; a row with fewer words has the whole sequence as one.

    ``words`` are word hashes in text order with their rows.
    """
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    if len(words) >= size:
        starts = np.flatnonzero(rows[:len(rows) - size + 1] == rows[size - 1:])
        acc = np.full(len(starts), np.uint64(size), np.uint64)
        for k in range(size):
            acc = mix(acc + words[starts + k])
        owner = rows[starts]
    else:
        acc, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for c in range(1, size):
        short = np.flatnonzero(count == c)
        if len(short):
            h = np.full(len(short), np.uint64(c), np.uint64)
            for k in range(c):
                h = mix(h + words[first[short] + k])
            acc, owner = np.concatenate([acc, h]), np.concatenate([owner, short])
    return acc, owner
