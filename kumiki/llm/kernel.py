"""Vectorised text kernel: words, word hashes and window hashes of an Arrow batch of texts, all in numpy.

Hashes are 64-bit. A word's hash is a polynomial over random values of its bytes, and a window's hash a polynomial over
the hashes of its words; both come from prefix sums modulo 2**64, so a window of any width costs one subtraction.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
_B = U(0x9E3779B97F4A7C15)  # odd, 5 modulo 8: prefix sums can be shifted back by its inverse
_W = U(0xD1342543DE82EF95)

#: Bytes of text that are looked at in one go; a longer text is one go of its own.
CHUNK_BYTES = 1 << 18


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def _byte_values(seed: int) -> np.ndarray:
    return splitmix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below n; kept for the largest n so far that isn't very large."""
    got = _powers.get(int(base))
    if got is None or len(got[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            up = np.full(size, base, U)
            up[0] = 1
            down = np.full(size, U(pow(int(base), -1, 1 << 64)), U)
            down[0] = 1
            got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 8 * CHUNK_BYTES:
            _powers[int(base)] = got
    return got[0][:n], got[1][:n]


def byte_table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Words are everything but space and \t \n \v \f \r.
NOT_SPACE = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
SAME = np.arange(256, dtype=np.uint8)


@dataclass
class Texts:
    """Some texts in a row: their bytes end to end, and where each begins; offs has one more entry."""

    first: int
    data: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1


def texts_of(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Slices of a string column of about size bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield Texts(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


@dataclass
class Words:
    """Words of Texts: begin and end in bytes, and the first word of each text (one more entry)."""

    begin: np.ndarray
    end: np.ndarray
    offs: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offs)


def words(t: Texts, inside: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of bytes that are inside; a run ends with its text."""
    n = len(t.data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(t) + 1, np.int64))
    on = inside[t.data]
    edge = np.zeros(n + 1, bool)
    edge[t.offs] = True
    start = on.copy()
    start[1:] &= ~on[:-1] | edge[1:n]
    stop = on.copy()
    stop[:-1] &= ~on[1:] | edge[1:n]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return Words(begin, end, np.searchsorted(begin, t.offs))


def word_hashes(t: Texts, w: Words, fold: np.ndarray = SAME, seed: int = 1) -> np.ndarray:
    n = len(t.data)
    up, down = powers(_B, n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, U)
        sums[0] = 0
        np.cumsum(_byte_values(seed)[fold][t.data] * up[:n], out=sums[1:])
        h = (sums[w.end] - sums[w.begin]) * down[w.begin]
        return splitmix(h + (w.end - w.begin).astype(U) * U(0xC2B2AE3D27D4EB4F))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for each i; those that run over the end of a text are the caller's to drop."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    up, down = powers(_W, n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, U)
        sums[0] = 0
        np.cumsum(h * up[:n], out=sums[1:])
        return splitmix((sums[k:] - sums[:-k]) * down[: n - k + 1] + U(k))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0]+lengths[0]-1, starts[1], ... as one array."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def windows_per_text(w: Words, k: int) -> np.ndarray:
    """Number of windows of k words of each text."""
    return np.maximum(0, w.counts() - k + 1)


def trimmed(rows: Iterator) -> Iterator:
    """Passes rows on, and then gives freed memory back to the system, so that an idle worker stays small."""
    yield from rows
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
