"""Hashed runs of words over whole Arrow columns, a piece of a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut into words at once; a longer text is one piece.
PIECE = 2 << 20
#: A bit table tells runs by so many of their first bits.
BITS = 24
#: Bytes of words as they are, all others as a space.
EVEN = np.array([b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256)], np.uint8)
MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of the texts of about ``PIECE`` bytes, by first and last row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + PIECE, side="right")))
        yield low, high
        low = high


def hashed(texts: pa.Array, n: int, among: np.ndarray | None = None) -> tuple[pa.Array, pa.Array]:
    """Row and 64-bit hash of every distinct run of ``n`` words of each lower-cased text (words as
    ``text.norm`` has them; null has none), or of those whose bit is set in the table ``among``.

    Each different word is hashed once; a run's hash mixes those of its words in their order."""
    rows = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    texts = texts.take(pa.array(rows))
    _, at, raw = texts.buffers()
    even = pa.Array.from_buffers(texts.type, len(texts), [None, at, pa.py_buffer(EVEN[np.frombuffer(raw, np.uint8)])]) if len(rows) else texts
    words = pc.ascii_split_whitespace(even)
    each, of = words.flatten(), np.repeat(np.arange(len(rows)), np.diff(words.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(each), 0)
    each, of = each.filter(some).dictionary_encode(), of[some.to_numpy(zero_copy_only=False)]
    known = pd.util.hash_array(each.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    own = known[each.indices.to_numpy(zero_copy_only=False)]
    count = np.bincount(of, minlength=len(rows))
    last = np.repeat(np.cumsum(count), count)
    made = max(len(own) - n + 1, 0)
    gram = np.zeros(made, np.uint64)
    for j in range(n if made else 0):
        gram ^= gram >> np.uint64(29)
        gram *= MIX
        gram += own[j : j + made]
    gram ^= gram >> np.uint64(32)
    gram *= MIX
    inside = np.arange(n, n + made) <= last[:made]
    if among is not None:
        place = gram >> np.uint64(64 - BITS)
        inside &= (among[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    at = np.flatnonzero(inside)
    row = rows[of[at]]
    found = pa.table({"row": pa.array(row, pa.int64()), "gram": pa.array(gram[at].view(np.int64))})
    found = found.group_by(["row", "gram"], use_threads=False).aggregate([]).combine_chunks()
    one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return one(found["row"]), one(found["gram"])
