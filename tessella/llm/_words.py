"""Vectorised word, shingle and window hashing over Arrow string buffers.

The text operators of this subpackage share these kernels.  They work on the
UTF-8 bytes that Arrow hands over, so no Python string is built, and on slices
of half a megabyte, so memory is bounded by the slice and not by the batch.
A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; those bytes
never occur inside a multi-byte UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, base, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_BYTES = _Powers(_BASE)
_BYTES_AGAIN = _Powers(0xC2B2AE3D27D4EB4F | 1)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) for runs of rows of about `limit` bytes.

    Null texts count as empty.  A text longer than the limit forms its own slice.
    """
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_null(column.type) else pa.large_binary())
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def strings(values: list[bytes]) -> pa.Array:
    """A string column of these bytes, valid UTF-8 or not."""
    a = pa.array(values, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(a), a.buffers(), offset=a.offset)


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (with an end mark)."""
    if len(buf) == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SPACE[buf]
    edge = offsets[(offsets > 0) & (offsets < len(buf))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
    """One 64-bit hash for each word; with lower, A-Z count as a-z; second gives another, independent of the first."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = (_BYTES_AGAIN if second else _BYTES).get(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    values = (_LOWER[buf] if lower else buf).astype(np.uint64)
    values += _U(1)
    values *= up[: len(buf)]
    np.cumsum(values, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h ^ (mix64((ends - starts).astype(np.uint64)) << _U(1)))


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside one text, and each text's first one (with an end mark).

    A text with 1 to width-1 words has one shingle, its whole word sequence.
    """
    n = np.diff(firsts)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.zeros(len(firsts), dtype=np.int64)
    np.cumsum(count, out=at[1:])
    out = np.zeros(int(at[-1]), dtype=np.uint64)
    if len(words) >= width:
        run = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for k in range(width):
            run *= _U(_BASE)
            run += words[k : k + len(run)]
        run = mix64(run)
        long = n >= width
        starts = np.repeat(firsts[:-1][long] - at[:-1][long], count[long])
        where = np.flatnonzero(np.repeat(long, count))
        out[where] = run[where + starts]
    for i in np.flatnonzero((n > 0) & (n < width)):
        h = int(n[i])
        for w in words[firsts[i] : firsts[i + 1]]:
            h = (h * _BASE + int(w)) & _MASK
        out[at[i]] = mix64(np.array([h ^ 0x5BD1E995], dtype=np.uint64))[0]
    return out, at


def window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rolling 64-bit polynomial hashes of all runs of `width` values, whatever text they belong to."""
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    powers = _WINDOW.setdefault(base, _Powers(base))
    up, down = powers.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * down[: len(words) - width + 1])


_WINDOW: dict[int, _Powers] = {}
