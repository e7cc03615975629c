"""Whole-column text arithmetic on Arrow buffers: words, word hashes, n-gram hashes.

A word is a maximal run of ASCII letters, digits and non-ASCII characters after A-Z are
lower-cased.  All functions work on the concatenated UTF-8 bytes of many documents, so
that a document costs no Python call of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20

_codes = np.arange(256, dtype=np.uint8)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
IS_WORD = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 2), base, dtype=U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U)
        if len(have) <= SLICE_BYTES + 2:
            _powers[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def slices(raw: np.ndarray, at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``limit`` bytes: first, last, bytes, offsets from 0."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


class Words:
    """The words of a slice: ``start``, ``end`` (bytes), ``doc``, ``hash``, and ``first``
    (index of each document's first word, with a final total)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        n = len(raw)
        self.low = low = LOWER[raw]
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = IS_WORD[low]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        here, before = inside[1:], inside[:-1]
        self.start = np.flatnonzero(here & (~before | edge))
        self.end = np.flatnonzero(before & (~here | edge))
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        total = np.zeros(n + 1, dtype=U)
        np.cumsum((low.astype(U) + U(1)) * powers(BASE, n), out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * powers(BASE_INVERSE, n + 1)[self.start])

    def text(self, i: int, j: int) -> bytes:
        """Words i to j-1, one space between."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of ``k`` words inside a document."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        total = np.zeros(n, dtype=U)
        for j in range(k):
            total += self.hash[j : j + n] * U(BASE_INVERSE ^ (2 * j + 2 * k * 1024))
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(total[at])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Document and hash of every run of ``k`` words; a document of fewer, but not
        none, has one shingle of all its words."""
        at, h = self.grams(k)
        doc = self.doc[at]
        count = np.diff(self.first)
        extra_doc, extra_hash = [], []
        for size in range(1, k):
            short = np.flatnonzero(count == size)
            if len(short):
                total = np.zeros(len(short), dtype=U)
                for j in range(size):
                    total += self.hash[self.first[short] + j] * U(BASE_INVERSE ^ (2 * j + 2 * size * 1024))
                extra_doc.append(short)
                extra_hash.append(mix(total))
        if extra_doc:
            doc = np.concatenate([doc, *extra_doc])
            h = np.concatenate([h, *extra_hash])
            order = np.argsort(doc, kind="stable")
            doc, h = doc[order], h[order]
        return doc, h
