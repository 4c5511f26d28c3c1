"""Vectorised text primitives over the UTF-8 buffer of an Arrow string column.

Nothing here loops over words or characters in Python. A batch is cut into
slices of whole documents of ``SLICE_BYTES`` at most; a document beyond that is a
``Long``, which is gone through in pieces of that size, with words and lines carried
over the cuts. So the temporaries stay bounded whatever the size of batches and texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time.
SLICE_BYTES = 1 << 20

_U, _M64 = np.uint64, (1 << 64) - 1
_P = _U(0x9E3779B97F4A7C15 | 1)
_PINV = _U(pow(int(_P), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all others."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


#: One random-looking 64-bit value per byte, from a rule.
BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=1)
def _powers(n: int = SLICE_BYTES + 8) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, for a slice: 16 MiB in all."""
    out = []
    for base in (_P, _PINV):
        a = np.full(n, base, np.uint64)
        a[0] = _U(1)
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


class Slice:
    """Some whole documents: ``b`` their bytes, ``off`` their n + 1 offsets."""

    def __init__(self, first: int, b: np.ndarray, off: np.ndarray):
        self.first, self.b, self.off = first, b, off
        self.n = len(off) - 1

    @cached_property
    def _sums(self) -> np.ndarray:
        """Sums of the bytes' keys times powers of the hash's base."""
        b, (p, _) = self.b, _powers()
        c = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(BYTE_KEYS[b] * p[: len(b)], out=c[1:])
        return c

    def raw_hash(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The same before it is mixed: of two stretches in a row it is raw + P ** length * raw."""
        return (self._sums[e] - self._sums[s]) * _powers()[1][s]

    def span_hash(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes in [s, e), equal for equal bytes anywhere."""
        return mix(self.raw_hash(s, e) + (e - s).astype(np.uint64))

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of ``inside`` that don't cross a document's edge."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edge = self.off[1:-1]
        edge = edge[(edge > 0) & (edge < len(inside))]
        starts[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def count(self, mask_or_positions: np.ndarray) -> np.ndarray:
        """How many marked bytes (a mask, or sorted positions) each document has."""
        a = mask_or_positions
        if a.dtype == bool:
            c = np.zeros(len(a) + 1, np.int64)
            np.cumsum(a, out=c[1:])
            return np.diff(c[self.off])
        return np.diff(np.searchsorted(a, self.off))

    def code_points(self) -> tuple[np.ndarray, np.ndarray]:
        """The documents' code points, and their n + 1 offsets in them."""
        cp = code_points(self.b)
        lead = (self.b & 0xC0) != 0x80
        c = np.zeros(len(lead) + 1, np.int64)
        np.cumsum(lead, out=c[1:])
        return cp, c[self.off]


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), off


def code_points(b: np.ndarray) -> np.ndarray:
    return np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


class Long:
    """One document that is gone through in pieces. ``b``: its bytes."""

    n = 1

    def __init__(self, first: int, b: np.ndarray):
        self.first, self.b = first, b

    def pieces(self, size: int | None = None) -> Iterator[np.ndarray]:
        """Its bytes in order, cut between characters."""
        size, at = size or SLICE_BYTES, 0
        while at < len(self.b):
            stop = min(at + size, len(self.b))
            if stop < len(self.b):
                stop = next((k for k in range(stop, stop - 4, -1) if k > at and self.b[k] & 0xC0 != 0x80), stop)
            yield self.b[at:stop]
            at = stop

    def spans(self, inside: np.ndarray, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each piece the spans of bytes of the table ``inside`` that end in it: (their ``span_hash``, whether they hold a word)."""
        raw0, n0, word0 = 0, 0, False
        for b in self.pieces(size):
            s = Slice(0, b, np.array([0, len(b)]))
            starts, ends = s.spans(inside[b])
            raw, n = s.raw_hash(starts, ends), ends - starts
            c = np.zeros(len(b) + 1, np.int64)
            np.cumsum(~WHITE[b], out=c[1:])
            word = c[ends] > c[starts]
            if n0 and len(starts) and starts[0] == 0:
                raw[0] = raw0 + int(raw[0]) * pow(int(_P), n0, 1 << 64) & _M64
                n[0] += n0
                word[0] |= word0
            elif n0:
                raw, n, word = np.append(_U(raw0), raw), np.append(n0, n), np.append(word0, word)
            n0 = 0
            if len(ends) and ends[-1] == len(b):
                raw0, n0, word0 = int(raw[-1]), int(n[-1]), bool(word[-1])
                raw, n, word = raw[:-1], n[:-1], word[:-1]
            yield mix(raw + n.astype(np.uint64)), word
        if n0:
            yield mix(np.array([raw0 + n0 & _M64], np.uint64)), np.array([word0])


def slices(col: pa.Array, size: int | None = None) -> Iterator[Slice | Long]:
    """The documents of a column in order; null counts as empty."""
    size = size or SLICE_BYTES
    data, off = string_buffers(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, "right")) - 1
        if j == i:
            yield Long(i, data[off[i] : off[i + 1]])
            i += 1
        else:
            yield Slice(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
            i = j


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i+1]] for each i, empty segments 0."""
    out = np.zeros(len(off) - 1, np.float64)
    full = off[1:] > off[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, off[:-1][full], dtype=np.float64)
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    m = np.zeros(len(keys), bool)
    m[order[1:]] = same
    m[order[:-1]] |= same
    return m


def later_copies(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    m = np.zeros(len(keys), bool)
    if len(keys) > 1:
        m[order[1:]] = s[1:] == s[:-1]
    return m
