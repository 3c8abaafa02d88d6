"""Words of many texts at once, as numpy arrays over Arrow's UTF-8 buffers.

A word is a run of bytes other than space and 0x09 to 0x0D. Hashes are polynomials modulo 2**64 over random
byte values, mixed afterwards, computed for whole slices without a Python loop over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SLICE_BYTES = 1 << 19  # text handled at once; temporary arrays take about 40 times as much

_space = np.zeros(256, dtype=bool)
_space[[0x20, 9, 10, 11, 12, 13]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_values = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; lengths are rounded up so that few tables are kept."""
    return _powers(base % 2**64, 1 << max(10, (n - 1).bit_length()))[:n] if n <= 1 << 24 else np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n - 1, base % 2**64, U)]))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser that spreads every bit over the whole word."""
    h = h + U((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own, never cut."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def strings(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """The inverse of ``flat``."""
    if off[-1] < 2**31:
        return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(buf).tobytes())])
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(buf).tobytes())])


class Words:
    """Words of the texts in buf[off[0]:off[-1]]: ``start``, ``end`` (bytes in buf) and ``first`` (index of each text's first word, and the end)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, fold: bool = False):
        self.buf, self.off = (_lower[buf] if fold else buf), off
        inside = ~_space[buf]
        edge = np.zeros(len(buf) + 1, dtype=bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        if len(buf):
            edge[0], edge[-1] = inside[0], inside[-1]
            cuts = np.unique(off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(buf))])
            both = cuts[inside[cuts] & inside[cuts - 1]]  # a word ends and another starts where texts meet
        else:
            both = np.zeros(0, np.int64)
        at = np.flatnonzero(edge)
        if len(both):
            at = np.sort(np.concatenate([at, both, both]))
        self.start, self.end = at[0::2], at[1::2]
        self.first = np.searchsorted(self.start, off, "left")
        self.n = np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        return spans(self.buf, self.start, self.end)


def spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = SLICE_BYTES) -> np.ndarray:
    """64-bit hash of each buf[start:end]; spans in ascending order and apart."""
    out = np.empty(len(start), dtype=U)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + most, "right")))
        a, b = int(start[lo]), int(end[hi - 1])
        if b - a > 4 * most and hi == lo + 1:
            out[lo] = int.from_bytes(hashlib.blake2b(buf[a:b].tobytes(), digest_size=8).digest(), "little")
        else:
            total = np.zeros(b - a + 1, dtype=U)
            np.cumsum(_values[buf[a:b]] * powers(_BASE, b - a), out=total[1:])
            s, e = start[lo:hi] - a, end[lo:hi] - a
            out[lo:hi] = (total[e] - total[s]) * powers(pow(_BASE, -1, 2**64), b - a)[np.minimum(s, b - a - 1)]
            out[lo:hi] = mix(out[lo:hi] + (e - s).astype(U))
        lo = hi
    return out


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k values of h: len(h) - k + 1 of them, those across texts included."""
    if len(h) < k:
        return np.zeros(0, dtype=U)
    base = _WORD_BASE + 8 * (seed * 0x632BE59B + seed)
    total = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(h * powers(base, len(h)), out=total[1:])
    n = len(h) - k + 1
    return mix((total[k:] - total[:n]) * powers(pow(base, -1, 2**64), n), seed)


def inside(words: Words, k: int) -> np.ndarray:
    """Starts of the runs of k words that lie within one text."""
    doc = words.doc()
    return np.flatnonzero(doc[: max(0, len(doc) - k + 1)] == doc[k - 1 :])
