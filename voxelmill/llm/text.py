"""Vectorised words and word n-grams of Arrow text columns.

Words are maximal runs of bytes in a class. All classes used here contain every byte from 0x80
on, so multi-byte UTF-8 characters are never cut. A word is known by a 64-bit fingerprint.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Lower-cased letters, digits and everything beyond ASCII.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: Everything but blanks.
NOT_BLANK = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1B54A32D192ED03)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n):
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = tuple(out)
    return _powers


@dataclass
class Words:
    """Words of the texts of a batch, in order; ``first[d] : first[d + 1]`` are those of text d."""
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    buffer: np.ndarray

    @property
    def counts(self):
        return np.diff(self.first)

    def text(self, i):
        return self.buffer[self.start[i]:self.end[i]].tobytes()


def text_buffer(texts: pa.Array):
    """Bytes of all texts one after the other and their offsets; null texts are empty."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, kind=ALNUM) -> Words:
    raw, offsets = text_buffer(texts)
    low = LOWER[raw]
    inside = kind[low]
    begin = np.zeros(len(low) + 1, bool)
    begin[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | begin[1:-1]
    last[:-1] &= ~inside[1:] | begin[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(max(len(low), 1))
    if len(start):
        value = (low.astype(np.uint64) + np.uint64(1)) * power[:len(low)]
        value[~inside] = 0
        h = np.add.reduceat(value, start) * inverse[start]
        h = mix(h ^ ((end - start).astype(np.uint64) << np.uint64(48)))
    else:
        h = np.zeros(0, np.uint64)
    bounds = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(h, start, end, doc, bounds, low)


def _combined(h, start, size):
    total = np.zeros(len(start), np.uint64)
    for j in range(size):
        total = total * _STEP + h[start + j]
    return mix(total ^ np.uint64(size))


def ngrams(w: Words, size):
    """Fingerprints, texts and first words of all n-grams of ``size`` words.

    A text with fewer words, but not none, has one n-gram of all its words.
    """
    n = len(w.hash)
    at = np.arange(max(n - size + 1, 0))
    at = at[w.doc[at] == w.doc[at + size - 1]] if len(at) else at
    parts = [(_combined(w.hash, at, size), at)]
    counts = w.counts
    for m in range(1, size):
        short = w.first[:-1][counts == m]
        if len(short):
            parts.append((_combined(w.hash, short, m), short))
    h, at = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
    if len(parts) > 1:
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, w.doc[at], at


def ranges(start, count):
    """start[0], start[0]+1, ..., for each of the ranges, and the number of its range."""
    owner = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    return np.arange(len(owner)) - before[owner] + start[owner], owner
