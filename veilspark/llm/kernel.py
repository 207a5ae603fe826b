"""Vectorised word and n-gram hashing over Arrow string buffers.

Everything here is pure numpy on the UTF-8 bytes that Arrow already holds, so
no per-word Python object is ever built.  Texts are handled in slices of at
most ``CHUNK_BYTES`` (a longer single text is a slice of its own), which keeps
the temporary arrays of a task small whatever the batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers."""
    with np.errstate(over="ignore"):
        z = x.astype(_U) + _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=_U)


_BASE = 0xD6E8FEB86659FD93
_BYTE = splitmix(np.arange(256, dtype=_U) + _U(0x5157))
_POW = _powers(_BASE, CHUNK_BYTES + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), CHUNK_BYTES + 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Blank bytes: space and tab to carriage return.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Words:
    """Words of a slice of rows ``first .. first + len(counts)``."""

    first: int
    counts: np.ndarray  # words of each row
    offsets: np.ndarray  # prefix sums of counts
    hashes: np.ndarray  # one 64-bit hash per word
    starts: np.ndarray  # byte offsets inside the slice
    ends: np.ndarray
    data: np.ndarray  # the lower-cased bytes of the slice
    begins: np.ndarray  # byte offset of each row, and the end

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off, raw


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, byte offsets) of slices of a string column; null counts as empty."""
    off, raw = _buffers(column)
    row, n = 0, len(column)
    while row < n:
        last = int(np.searchsorted(off, off[row] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, row + 1), n)
        yield row, _LOWER[raw[off[row] : off[last]]], off[row : last + 1] - off[row]
        row = last


def words(column: pa.Array, letters: np.ndarray | None = None) -> Iterator[Words]:
    """Maximal runs of bytes that are not blank (or that ``letters`` marks), with A-Z lower-cased."""
    global _POW, _INV
    for first, data, begins in slices(column):
        n = len(data)
        if n > len(_POW):
            _POW, _INV = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1)
        inside = ~BLANK[data] if letters is None else letters[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[begins] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        sums = np.zeros(n + 1, dtype=_U)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * _POW[:n], out=sums[1:])
            hashes = splitmix((sums[ends] - sums[starts]) * _INV[starts] + (ends - starts).astype(_U))
        offsets = np.searchsorted(starts, begins)
        yield Words(first, np.diff(offsets), offsets, hashes, starts, ends, data, begins)


_MULT = splitmix(np.arange(64, dtype=_U) + _U(977)) | _U(1)


def ngrams(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles, and how many each row has; a shorter row has its whole sequence as one."""
    n = len(w.hashes)
    counts = np.where(w.counts >= size, w.counts - size + 1, (w.counts > 0).astype(w.counts.dtype))
    total = int(counts.sum())
    first = np.repeat(w.offsets[:-1], counts)
    own = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first + own
    h = np.full(total, 0xA0761D6478BD642F, dtype=_U)
    short = np.repeat(np.minimum(w.counts, size), counts)
    with np.errstate(over="ignore"):
        for k in range(size):
            there = np.minimum(at + k, max(n - 1, 0))
            h += np.where(k < short, w.hashes[there] * _MULT[k], _U(0)) if n else _U(0)
        h += short.astype(_U)
    return splitmix(h), counts
