"""Vectorised tokenising and hashing of whole texts, straight from Arrow buffers.

A text column arrives as one byte buffer and offsets.  Word boundaries, word hashes and n-gram hashes
of all its rows are found with a few numpy passes; no row is visited in Python.  Work is cut into
slices of about ``SLICE`` bytes so that temporary arrays stay small whatever the batch size; a single
text longer than that is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_OTHER = mix(np.arange(256, 512, dtype=np.uint64))
_OTHER[65:91] = _OTHER[97:123]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]

#: Letters, digits and everything beyond ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Everything but ASCII white space: ``[^\x20\x09-\x0D]+``.
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after another, and n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        if column.null_count:
            column = column.fill_null("")
    elif column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(data: np.ndarray, off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi of at most ``limit`` bytes together (one row may be longer): lo, hi, bytes, offsets."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Words of a slice: ``starts``/``ends`` (bytes), ``doc`` (row of each word), ``first`` (n + 1 word offsets)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray):
        inside = kind[data]
        n = len(data)
        edge = np.empty(n + 1, bool)
        begin, end = inside.copy(), np.empty(n, bool)
        if n:
            begin[1:] &= ~inside[:-1]
            end[:-1] = inside[:-1] & ~inside[1:]
            end[-1] = inside[-1]
            cuts = off[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]  # words never cross rows
            begin[cuts] = inside[cuts]
            end[cuts - 1] = inside[cuts - 1]
        self.data, self.off = data, off
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)
        del edge

    def hashes(self, table: np.ndarray = _FOLDED) -> np.ndarray:
        """A 64-bit hash of each word, A-Z lower-cased; ``_OTHER`` makes hashes that are independent of the usual ones."""
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(table[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts] ^ (self.ends - self.starts).astype(np.uint64))

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """All words, A-Z lower-cased, each with one space after it, and n + 1 places: words i to j are ``raw[places[i] : places[j] - 1]``."""
        length = self.ends - self.starts + 1
        places = np.append(0, np.cumsum(length))
        at = np.arange(places[-1]) + np.repeat(self.starts - places[:-1], length)
        out = _LOWER[self.data[np.minimum(at, max(0, len(self.data) - 1))]] if len(length) else np.zeros(0, np.uint8)
        out[places[1:] - 1] = 32
        return out.tobytes(), places

    def runs(self, size: int) -> np.ndarray:
        """Positions at which ``size`` words of one row begin."""
        at = np.arange(max(0, len(self.doc) - size + 1))
        return at[self.doc[at] == self.doc[at + size - 1]] if size > 1 else at


def together(hashes: np.ndarray, at: np.ndarray, steps: tuple[int, ...], salt: int) -> np.ndarray:
    """Hash of the words at ``at + step``, in that order."""
    out = np.full(len(at), np.uint64(salt))
    for step in steps:
        out = mix(out * np.uint64(_BASE) ^ hashes[at + step])
    return out
