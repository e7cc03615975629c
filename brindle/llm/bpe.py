"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word's parts are held as a list of boundaries beside a list of the ranks of adjacent
pairs.  The smallest rank is found by scanning, its inner boundary is deleted, and the
ranks on both sides are refreshed.  Words beyond ``SCAN_LIMIT`` bytes keep the same order
of merges in a heap, as rescanning them would take quadratic time.

The vocabulary file is a parameter (a ``tokenizers`` JSON file of a byte-level BPE without
normaliser); its content is broadcast.  Strings of its special tokens become their ids;
special tokens that take in spaces or whole words aren't supported and raise an error.

Ids of words and of what follows a space are kept as packed integers.  The ids of every
document are decoded, all documents of a slice at once: each id's bytes are gathered from
the vocabulary's bytes.

Cases: null and empty texts have no ids; any valid UTF-8 is accepted; very long texts and
words are encoded whole; of equal ranks (ties) the first place merges first; repeated rows
stay; an empty table gives none; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.textvec import slices, utf8

SCAN_LIMIT = 128
#: So many words or fewer are merged one by one, more of them together; the ids are the same.
MANY_WORDS = 200
CACHE_ENTRIES = 150_000
NO_RANK = 1 << 30
BATCH_BYTES = 4 << 20

#: Fixed value: how the vocabulary's authors split text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_vocabulary(path: str) -> dict:
    """Merge ranks, token bytes and special tokens of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    for t in spec["added_tokens"]:
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
            raise ValueError(f"{path}: special token {t['content']!r} isn't plain")
    return {"vocab": spec["model"]["vocab"], "merges": spec["model"]["merges"], "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}


class Kept:
    """Ids (packed, four bytes each) of strings met lately: two generations, of which the
    older is dropped when the newer is full."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def unknown(self, wanted: set[str]) -> list[str]:
        """Those not kept; those in the older generation move to the newer."""
        missing = wanted.difference(self.new)
        for key in [k for k in missing if k in self.old]:
            self.new[key] = self.old[key]
            missing.discard(key)
        return list(missing)

    def turn(self) -> None:
        """Called between batches."""
        if len(self.new) >= CACHE_ENTRIES:
            self.old, self.new = self.new, {}

    def rest(self) -> None:
        """Called after a task: a worker that waits holds the newer generation alone."""
        self.old = {}


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Pieces:
    """A string of bytes for each id; those of many ids are gathered at once."""

    def __init__(self, of: dict[int, bytes]):
        size = np.zeros(max(of, default=0) + 2, np.int32)
        size[[i + 1 for i in of]] = [len(b) for b in of.values()]
        self.start = np.cumsum(size, dtype=np.int32)
        self.data = np.frombuffer(b"".join(of[i] for i in sorted(of)), np.uint8)

    def gather(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of the ids, one after another, and where each id's string ends."""
        start = self.start[ids]
        size = self.start[ids + 1] - start
        end = np.cumsum(size, dtype=np.int64)
        at = np.repeat(start - (end - size), size)
        at += np.arange(len(at))
        return self.data[at].tobytes(), end


class Codec:
    """Encodes and decodes; keeps what it has encoded, up to ``CACHE_ENTRIES`` of each kind."""

    def __init__(self, vocabulary: dict):
        to_byte = byte_alphabet()
        vocab = vocabulary["vocab"]
        self.bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        self.ranks, self.made = {}, []
        for rank, merge in enumerate(vocabulary["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        order = sorted(self.ranks)
        self.pair_keys = np.array(order, np.int64)
        self.pair_ranks = np.array([self.ranks[k] for k in order], np.int64)
        self.made_ids = np.array(self.made, np.int64)
        self.id_of_byte = [vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        self.byte_ids = np.array(self.id_of_byte, np.int64)
        left, right = np.meshgrid(self.byte_ids, self.byte_ids, indexing="ij")
        self.byte_ranks = self.rank_of(left.ravel(), right.ravel()).reshape(256, 256)
        self.special = vocabulary["special"]
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.words_in = regex.compile(WORD).findall
        self.odd_space = regex.compile(r" \p{White_Space}| \Z").search
        self.words, self.spaced = Kept(), Kept()
        self.raw, self.decimal = Pieces(self.bytes_of), Pieces({i: b"%d," % i for i in self.bytes_of})

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.id_of_byte[b] for b in word]
        if len(ids) > SCAN_LIMIT:
            return self.merge_long(ids)
        get, made, none = self.ranks.get, self.made, NO_RANK
        ranks = [get(a << 32 | b, none) for a, b in pairwise(ids)]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            new = ids[i] = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 32 | ids[i + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """As merge(), by a heap of (rank, place) over linked parts."""
        n, get, made = len(ids), self.ranks.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            new = ids[i] = made[rank]
            ids[j], after[i] = -1, after[j]
            if (k := after[i]) < n:
                before[k] = i
                if (rank := get(new << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (rank, i, new, ids[k]))
            if (h := before[i]) >= 0 and (rank := get(ids[h] << 32 | new)) is not None:
                heapq.heappush(heap, (rank, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NO_RANK where a pair never merges."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """merge() of many words: a row of part ids and a row of adjacent ranks for each
        word, all rows scanned, shortened and refreshed together."""
        out: list[list[int]] = [[]] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for high in (4, 8, 12, 16, 24, 40, 64):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            for part in np.array_split(rows, len(rows) // 20_000 + 1):
                if len(part):
                    self._merge_block([words[i] for i in part], size[part], high, part, out)
        for i in np.flatnonzero(size > low).tolist():
            out[i] = self.merge(words[i])
        return out

    def _merge_block(self, words, size, width, rows, out) -> None:
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        used = np.arange(width) < size[:, None]
        ids = np.where(used, self.byte_ids[raw], -1)
        ranks = np.full((len(words), width), NO_RANK, np.int64)
        pair = used[:, 1:]
        ranks[:, :-1][pair] = self.byte_ranks[raw[:, :-1][pair], raw[:, 1:][pair]]
        count, place, column = size.copy(), np.arange(len(words)), np.arange(width)
        final = [None] * len(words)
        while len(place):
            i = ranks.argmin(axis=1)
            row = np.arange(len(place))
            least = ranks[row, i]
            done = least == NO_RANK
            if done.any():
                for k, p, n in zip(np.flatnonzero(done).tolist(), place[done].tolist(), count[done].tolist(), strict=True):
                    final[p] = ids[k, :n].tolist()
                left = ~done
                ids, ranks, count, place, i, least = ids[left], ranks[left], count[left], place[left], i[left], least[left]
                row = np.arange(len(place))
                if not len(place):
                    break
            new = self.made_ids[least]
            ids[row, i] = new
            shift = np.minimum(column + (column > i[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, 1)
            shift = np.minimum(column + (column >= i[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, shift, 1)
            count -= 1
            ids[row, count] = -1
            ranks[row, count - 1] = NO_RANK
            has = np.flatnonzero(i > 0)
            ranks[has, i[has] - 1] = self.rank_of(ids[has, i[has] - 1], new[has])
            has = np.flatnonzero(i < count - 1)
            ranks[has, i[has]] = self.rank_of(new[has], ids[has, i[has] + 1])
        for p, r in enumerate(rows.tolist()):
            out[r] = final[p]

    def encode_plain(self, text: str) -> list[int]:
        """Ids of text without special tokens."""
        words = self.words_in(text)
        self.learn_words(set(words))
        ids = array("i")
        ids.frombytes(b"".join(map(self.words.new.__getitem__, words)))
        return ids.tolist()

    def learn_words(self, words: set[str]) -> None:
        """Encode the words that aren't kept."""
        need = self.words.unknown(words)
        raw = [w.encode() for w in need]
        for w, ids in zip(need, self.merge_many(raw) if len(raw) > MANY_WORDS else map(self.merge, raw), strict=True):
            self.words.new[w] = packed(ids)

    def encode(self, text: str) -> list[int]:
        if self.split_special is None:
            return self.encode_plain(text)
        ids = []
        for piece in self.split_special(text):
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                ids += self.encode_plain(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text; bytes that aren't UTF-8 become U+FFFD."""
        return valid(b"".join(map(self.bytes_of.__getitem__, ids)))

    def words_of(self, chunk: str) -> list[str]:
        """The words of a space and what follows it up to the next."""
        body = chunk[1:]
        if body.isalpha():
            return [chunk]
        if body[-1:] in ",." and body[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.words_in(chunk)

    def learn(self, chunks: set[str]) -> None:
        """Encode what follows spaces and isn't kept."""
        need = self.spaced.unknown(chunks)
        split = [self.words_of(" " + c) for c in need]
        self.learn_words({w for words in split for w in words})
        known, spaced = self.words.new, self.spaced.new
        for c, words in zip(need, split, strict=True):
            spaced[c] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: the number of ids, SHA-256 of the ids, SHA-256 of the decoded text.

        No word crosses a space before a character that isn't white space, so an ordinary
        text is cut at its spaces and the pieces are looked up.
        """
        self.words.turn()
        self.spaced.turn()
        cut = [None if any(s in t for s in self.special) or self.odd_space(t) else t.split(" ") for t in texts]
        known, encoded = self.spaced.new, []
        found = [list(map(known.get, c[1:])) if c else [] for c in cut]
        missing = [None in got for got in found]
        self.learn({p for c, got, some in zip(cut, found, missing, strict=True) if some for p, ids in zip(c[1:], got, strict=True) if ids is None})
        for text, pieces, got, some in zip(texts, cut, found, missing, strict=True):
            if pieces and text:
                head = [packed(self.encode_plain(pieces[0]))] if pieces[0] else []
                encoded.append(b"".join(head + (list(map(known.__getitem__, pieces[1:])) if some else got)))
            else:
                encoded.append(packed(self.encode(text)))
        count = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        last = np.cumsum(count)
        ids = np.frombuffer(b"".join(encoded), np.int32)
        out = [count.tolist()]
        for pieces, finish in ((self.decimal, lambda raw: raw[:-1]), (self.raw, valid)):
            joined, end = pieces.gather(ids)
            bounds = np.concatenate([[0], end])[np.concatenate([[0], last])].tolist()
            out.append([_sha(finish(joined[a:b])) for a, b in pairwise(bounds)])
        return list(zip(*out, strict=True))


def valid(raw: bytes) -> bytes:
    """UTF-8; bytes that aren't become U+FFFD."""
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode(errors="replace").encode()
    return raw


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


_CODECS: dict[str, Codec] = {}


def codec(vocabulary) -> Codec:
    """One codec for each vocabulary and Python worker, kept between tasks."""
    key = f"{id(vocabulary)}" if isinstance(vocabulary, dict) else f"broadcast {vocabulary.value['name']}"
    if key not in _CODECS:
        _CODECS.clear()
        gc.disable()  # millions of kept strings, no cycles
        _CODECS[key] = Codec(vocabulary if isinstance(vocabulary, dict) else vocabulary.value)
    return _CODECS[key]


def _broadcast(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(load_vocabulary(path) | {"name": path})


def text_slices(column: pa.Array):
    """First and last row of runs of about ``BATCH_BYTES`` of text."""
    for first, last, _, _ in slices(*utf8(column), BATCH_BYTES):
        yield first, last


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the list of ids of every text."""
    vocabulary = _broadcast(docs, path)

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            for first, last in text_slices(batch["text"]):
                part = batch.slice(first, last - first)
                ids = [own.encode(t or "") for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that a list of ids stands for; null ids count as none."""
    vocabulary = _broadcast(encoded, path)

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            text = [own.decode(ids or []).decode() for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, in one pass."""
    vocabulary = _broadcast(docs, path)

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            for first, last in text_slices(batch["text"]):
                part = batch.slice(first, last - first)
                n, ids, text = zip(*own.digests([t or "" for t in part["text"].to_pylist()]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        own.words.rest()
        own.spaced.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
