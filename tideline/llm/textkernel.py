"""Vectorised word splitting and hashing over Arrow string buffers.

A column chunk is one byte buffer plus offsets.  Words are found and hashed with numpy over the
buffer itself, so no Python object is made per word.  Work goes in slices of ``SLICE`` bytes cut
at separators, which bounds the temporaries for texts of any length.

Defined cases: a null or empty text, or one of separators only, has no words.
"""

from __future__ import annotations

import numpy as np

SLICE = 1 << 17
_R = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)


def tidy() -> None:
    """Gives memory that a worker has freed back to the system, so that workers at rest hold little."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidied(run):
    """``run`` (batches -> batches), with ``tidy`` when it has ended."""

    def ran(batches):
        yield from run(batches)
        tidy()

    return ran


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Splitter:
    """Splits buffers into words at ``separators`` (byte values); ``fold`` lower-cases A-Z.

    kinds: a number for each byte value.  Words are cut in two between bytes of different kinds, and between any of
    kind 3; kind 0 is never cut off."""

    def __init__(self, separators, fold: bool, seed: int = 20240101, kinds: np.ndarray | None = None):
        self.kinds = kinds
        self.sep = np.zeros(256, bool)
        self.sep[list(separators)] = True
        self.values = _table(seed)
        if fold:
            self.values[65:91] = self.values[97:123]
        self.values[self.sep] = 0
        self._grow(SLICE + 1)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _R)]), dtype=np.uint64)
            back = np.uint64(pow(int(_R), -1, 1 << 64))
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, back)]), dtype=np.uint64)

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """-> (hashes, starts, ends, first): word ``w`` is ``data[starts[w]:ends[w]]``; text ``d``
        has the words ``first[d]:first[d + 1]``."""
        lo, end = int(offsets[0]), int(offsets[-1])
        hashes, starts, ends = [], [], []
        while lo < end:
            hi = self._cut(data, offsets, lo, end)
            part = data[lo:hi]
            if len(part) >= len(self.power):
                self._grow(len(part) + 1)
            word = ~self.sep[part]
            begin, stop = word.copy(), word.copy()
            begin[1:] &= ~word[:-1]
            stop[:-1] &= ~word[1:]
            a, b = np.searchsorted(offsets, [lo, hi])
            inner = offsets[a:b] - lo
            inner = inner[(inner > 0) & (inner < len(part))]
            begin[inner] = word[inner]
            stop[inner - 1] = word[inner - 1]
            if self.kinds is not None:
                kind = self.kinds[part]
                apart = (kind[1:] != 0) & (kind[:-1] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 3))
                begin[1:] |= apart
                stop[:-1] |= apart
            s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.values[part] * self.power[: len(part)], out=sums[1:])
            h = (sums[e] - sums[s]) * self.inverse[s]
            hashes.append(mix(h ^ ((e - s).astype(np.uint64) << np.uint64(48))))
            starts.append(s + lo)
            ends.append(e + lo)
            lo = hi
        if not hashes:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
        h, s, e = map(np.concatenate, (hashes, starts, ends))
        return h, s, e, np.searchsorted(s, offsets)

    def cut(self, data: np.ndarray, lo: int, end: int, size: int) -> int:
        """Where a part of about ``size`` bytes from ``lo`` on ends: behind a separator, or at ``end``."""
        top = lo + size
        while top < end:
            if len(at := np.flatnonzero(self.sep[data[top : min(end, top + SLICE)]])):
                return top + int(at[0]) + 1
            top += SLICE
        return end

    def _cut(self, data: np.ndarray, offsets: np.ndarray, lo: int, end: int) -> int:
        """The end of the slice from ``lo``: at a text's end or behind a separator."""
        if end - lo <= SLICE:
            return end
        top = lo + SLICE
        k = int(np.searchsorted(offsets, top, "right")) - 1
        if offsets[k] > lo:
            return int(offsets[k])
        if len(at := np.flatnonzero(self.sep[data[lo:top]])):
            return lo + int(at[-1]) + 1
        stop = int(offsets[k + 1])  # one word longer than a slice: on to where it ends
        while top < stop:
            if len(at := np.flatnonzero(self.sep[data[top : min(stop, top + SLICE)]])):
                return top + int(at[0]) + 1
            top += SLICE
        return stop


def windows(hashes: np.ndarray, first: np.ndarray, k: int, seed: int = 0):
    """Hashes of all ``k`` consecutive words of one text: (hash, position of the first word)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        step = _SHINGLE + np.uint64(2 * seed)
        for j in range(1, k):
            out *= step
            out += hashes[j : j + n]
    keep = np.ones(n, bool)
    inner = first[1:-1]
    for j in range(1, k):
        at = inner - j
        keep[at[(at >= 0) & (at < n)]] = False
    pos = np.flatnonzero(keep)
    return mix(out[pos]), pos


def string_buffer(column):
    """(bytes, offsets) of an Arrow string or binary array; nulls are empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), off


SPACES = (0x20, *range(0x09, 0x0E))
