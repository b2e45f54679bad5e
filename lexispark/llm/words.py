"""Vectorised word handling for Arrow batches.

A batch's text column is one UTF-8 buffer with offsets.  Everything here works on that buffer with
numpy, in slices of about a megabyte, so memory does not follow the batch or (much) the document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# A Python worker lives through many tasks: large buffers shall go back to the system as soon as they are freed, not
# stay with the worker (3 names glibc's limit from which allocations are mapped one by one).
pa.set_memory_pool(pa.system_memory_pool())
if hasattr(_libc := ctypes.CDLL(None), "mallopt"):
    _libc.mallopt(-3, 1 << 20)

SLICE_BYTES = 1 << 20
SLICE_DOCS = 1000

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of most contracts: anything but the six ASCII white-space characters.
BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[9, 10, 11, 12, 13, 32]] = False
#: Words of the contamination contract: ASCII letters and digits and everything outside ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SYMBOL = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, SLICE_BYTES + 65536), base, dtype=_U)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:n]


def rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The batch's rows, one at a time: wide binary columns are never copied all at once."""
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


@dataclass
class Slice:
    """Some consecutive documents of a batch: rows lo..hi, their bytes, and offsets into those."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES, docs: int = SLICE_DOCS) -> Iterator[Slice]:
    """Cut a text column into slices of at most `limit` bytes (or one document) and `docs` documents."""
    data, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = max(lo + 1, min(hi, n, lo + docs))
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """The words of a slice in text order: byte ranges, document (row within the slice), 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    per_doc: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each document's first word, and the total at the end."""
        return np.concatenate(([0], np.cumsum(self.per_doc)))


def bounds(s: Slice, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of maximal runs of word bytes; a run never crosses a document's edge."""
    inside = is_word[s.data]
    n = len(inside)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[s.offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (~before | edge[:n])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def words(s: Slice, is_word: np.ndarray = BLANK_SEPARATED, lower: bool = True) -> Words:
    """The slice's words; with `lower`, A-Z are lower-cased for the hash.

    The hash is a polynomial over the word's bytes modulo 2**64, taken from one running sum over the
    whole slice, then mixed together with the length."""
    start, end = bounds(s, is_word)
    sums = np.zeros(len(s.data) + 1, dtype=_U)
    np.cumsum(_SYMBOL[_LOWER[s.data] if lower else s.data] * powers(_BASE, len(s.data)), out=sums[1:])
    h = (sums[end] - sums[start]) * powers(_INVERSE, len(s.data) + 1)[start]
    h = mix(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))
    doc = np.searchsorted(s.offsets, start, "right") - 1
    return Words(start, end, doc, h, np.bincount(doc, minlength=s.hi - s.lo))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each window of `size` words; a shorter document that has words is one window."""
    factor = mix(np.arange(11, 11 + size, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
    n = len(w.hash)
    short = np.flatnonzero((w.per_doc > 0) & (w.per_doc < size))
    full = max(0, n - size + 1)
    if full:
        whole = w.doc[:full] == w.doc[size - 1 :]
        h = np.zeros(full, dtype=_U)
        for j in range(size):
            h += w.hash[j : j + full] * factor[j]
        doc, h = w.doc[:full][whole], mix(h[whole])
    else:
        doc, h = np.empty(0, np.int64), np.empty(0, _U)
    if len(short):
        first = w.first
        extra = np.array([np.sum(w.hash[first[d] : first[d + 1]] * factor[: w.per_doc[d]]) + _U(int(w.per_doc[d])) for d in short], dtype=_U)
        doc, h = np.concatenate((doc, short)), np.concatenate((h, mix(extra)))
    return doc, h
