"""Vectorised words, hashes and windows over a batch of texts.

A batch is one Arrow string column. Its UTF-8 bytes are read in place, so a
word costs a few array operations and no Python object. Words are maximal runs
of bytes other than space and \\t\\n\\v\\f\\r, which is the word pattern that
all operators here share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 - 8          # odd, 5 modulo 8
_INV = pow(_BASE, -1, 1 << 64)
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(max(n, SLICE_BYTES), base, dtype=_U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mix (shifts and odd multipliers)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def slices(column: pa.ChunkedArray | pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Cut a string column at row bounds into pieces of about ``limit`` bytes: (first row, piece)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, column.slice(at, to - at)
        at = to


class Words:
    """Words of a piece of a string column.

    ``offsets[i]:offsets[i+1]`` are the words of text i; ``start``/``end`` are
    byte positions in ``data``; ``text_at`` bounds each text's bytes. ``blank``
    marks bytes that separate words besides white space.
    """

    def __init__(self, column: pa.Array, lower: bool = True, blank: np.ndarray | None = None):
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        raw = raw[bounds[0]:bounds[-1]]
        self.raw = raw
        self.data = _LOWER[raw] if lower else raw
        self.text_at = bounds - bounds[0]
        inside = ~(_WS if blank is None else _WS | blank)[raw]
        first, last = inside.copy(), inside.copy()
        if len(raw):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            begins = self.text_at[:-1][self.text_at[:-1] < len(raw)]
            first[begins] |= inside[begins]
            before = begins[begins > 0] - 1
            last[before] |= inside[before]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.start, self.text_at)
        self.counts = np.diff(self.offsets)
        self.doc = np.repeat(np.arange(len(column)), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, _U)
        power, inverse = _power_tables(len(self.data))
        sums = np.zeros(len(self.data) + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * power, out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * inverse[self.start]
        return mix(h + (self.end - self.start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.text_at[1:]] - total[self.text_at[:-1]]

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sum of a per-word array over each text."""
        total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int, whole_short: bool = False):
    """Hash of each run of ``size`` words inside one text: (hash, first word, text).

    With ``whole_short`` a text of 1 to size-1 words gives one window over all its words.
    """
    n = np.diff(offsets)
    per = np.maximum(n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), per)
    first = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(offsets[:-1], per)
    h = np.zeros(len(first), _U)
    for k in range(size):
        h = h * _U(0x9FB21C651E98DF25) + hashes[first + k]
    h = mix(h)
    if whole_short:
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            own = []
            for d in short:
                x = _U(0)
                with np.errstate(over="ignore"):
                    for w in hashes[offsets[d]:offsets[d + 1]]:
                        x = x * _U(0x9FB21C651E98DF25) + w
                    own.append(x + _U(int(n[d])))
            h = np.concatenate([h, mix(np.array(own, _U))])
            first = np.concatenate([first, offsets[:-1][short]])
            doc = np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            h, first, doc = h[order], first[order], doc[order]
    return h, first, doc
