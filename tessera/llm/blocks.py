"""Vectorised words of Arrow text columns.

The operators of this package that read whole texts in Arrow batches share
these helpers.  A batch is cut into runs of documents of about ``CHUNK``
bytes, so the numpy work space stays bounded whatever the batch holds (one
longer document forms a run of its own).  A null text counts as empty.

Words are maximal runs of bytes other than space and 0x09-0x0D, after A-Z are
lower-cased; all other bytes are kept, so UTF-8 letters stay whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C55)
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_powers = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (shift-xor and odd multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(col: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return memoryview(b""), np.zeros(len(col) + 1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    return memoryview(data if data is not None else b""), off


def runs(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive document ranges [i, j) of at most ``limit`` bytes, or of one document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def documents(col: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, one after the other."""
    data, off = text_buffers(col)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield bytes(data[a:b])


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(raw: bytes, size: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text, case kept, in lists of about ``size`` bytes of text: memory is bounded whatever its length."""
    at = 0
    while at < len(raw):
        end = _SPACE.search(raw, at + size) if at + size < len(raw) else None
        stop = end.start() if end else len(raw)
        yield raw[at:stop].split()  # parts at 0x20 and 0x09-0x0D
        at = stop


def word_spans(raw: np.ndarray, bounds: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts, and how many words lie before each text.

    ``bounds`` are the n + 1 text offsets in ``raw``; a word never crosses one.
    ``letters`` says of each byte value whether words hold it.
    """
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(bounds), dtype=np.int64)
    word = letters[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = bounds[bounds < len(raw)]
    start[inner] = word[inner]
    end = np.empty(len(raw), dtype=bool)
    end[:-1] = word[:-1] & (~word[1:] | start[1:])
    end[-1] = word[-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, bounds, side="left")


def span_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial in the bytes, weighted by the place in the span, then mixed.

    Spans must be in order and not overlap.
    """
    global _powers
    if not len(s):
        return np.zeros(0, dtype=np.uint64)
    size = e - s
    longest = int(size.max())
    if len(_powers) < longest:
        _powers = np.cumprod(np.full(max(longest, 256), _BASE, dtype=np.uint64))
    first = np.zeros(len(s), dtype=np.int64)
    np.cumsum(size[:-1], out=first[1:])
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    at = place + np.repeat(s, size)
    terms = (raw[at].astype(np.uint64) + np.uint64(1)) * _powers[place]
    return mix64(np.add.reduceat(terms, first) + size.astype(np.uint64))


class WordRun:
    """The words of a run of documents: hashes, spans and the first word of each document."""

    def __init__(self, data: memoryview, offsets: np.ndarray, i: int, j: int, letters: np.ndarray = NOT_SPACE):
        a, b = int(offsets[i]), int(offsets[j])
        self.first_doc, self.docs = i, j - i
        self.raw = np.frombuffer(bytes(data[a:b]).lower(), dtype=np.uint8)
        self.bounds = np.asarray(offsets[i:j + 1]) - a
        self.start, self.end, self.before = word_spans(self.raw, self.bounds, letters)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.raw, self.start, self.end)
        return self._hash


def word_runs(col: pa.Array) -> Iterator[WordRun]:
    data, off = text_buffers(col)
    for i, j in runs(off):
        yield WordRun(data, off, i, j)
