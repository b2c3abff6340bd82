"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts are cut into lines where no word crosses the cut, and lines into words by the tokenizer's pattern. Lines that the
worker has met lately (revisions of a page share most of theirs) keep their ids. The distinct words of the other lines
that it has not met lately are encoded together: bytes of words of similar length fill a padded matrix, and in each round every row merges its
leftmost pair of minimum rank, found by a hashed pair table; rows without a pair left are taken out (compaction).
Words too long for a matrix go through a heap of pairs, in n log n steps; the result is the same.

Nothing is shuffled. The vocabulary (a fixed file, under 1 MB) is the only thing sent to all tasks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.storage import free_name, spread

#: Where the public tokenizers' files lie, and the default vocabulary.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for ASCII text, for the faster engine.
ASCII = r"""'(?:[stmd]|re|ve|ll)| ?(?:[A-Za-z]+|[0-9]+|[^\t-\r A-Za-z0-9]+)|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
#: Words kept with their ids, the longest word (bytes) that goes into a matrix, and the cells of a matrix.
CACHE, LONGEST, CELLS = 1 << 18, 256, 1 << 18
#: Characters of the texts whose new words are encoded together, and of the lines kept with their ids.
TOGETHER, LINES = 1 << 21, 1 << 23
NONE = np.int32(2**31 - 1)


def lines(text: str) -> list[str]:
    """The text in pieces that are cut before a line feed behind a character that is no white space: no word of the
    pattern holds both, and none looks beyond a following line feed, so the pieces have the words of the text."""
    out, start, i = [], 0, text.find("\n", 1)
    while i >= 0:
        if not text[i - 1].isspace():
            out.append(text[start:i])
            start = i
        i = text.find("\n", i + 1)
    out.append(text[start:])
    return out


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their merge (which is its rank)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(merged) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, NONE, np.int32)
        key = self.key(left, right)
        at, todo, self.probes = self.hash(key), np.arange(len(key)), 0
        while todo.size:  # all keys that found their slot taken move on together
            self.probes += 1
            slot = at[todo]
            free = self.keys[slot] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            win = free & first
            self.keys[slot[win]], self.ids[slot[win]] = key[todo[win]], merged[todo[win]]
            todo = todo[~win]
            at[todo] = (at[todo] + 1) & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def hash(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merges, NONE where there is none or where an id is negative (padding)."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(left.size, NONE, np.int32)
        todo = np.nonzero((left >= 0) & (right >= 0))[0]
        key = self.key(left[todo], right[todo])
        at = self.hash(key)
        for _ in range(self.probes):
            if not todo.size:
                break
            there = self.keys[at]
            hit = there == key
            out[todo[hit]] = self.ids[at[hit]]
            on = ~hit & (there >= 0)
            todo, key, at = todo[on], key[on], (at[on] + 1) & self.mask
        return out.reshape(shape)


class Encoder:
    """A byte-level BPE vocabulary, ready to encode words and texts."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines())}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.byte_list = self.byte.tolist()
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.table = PairTable(*np.array(pairs, np.int64).T.astype(np.int32))
        self.pairs = {(a, b): r for a, b, r in pairs}
        self.split, self.split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII).findall
        self.words: dict[str, bytes] = {}
        self.lines: dict[str, bytes] = {}
        self.kept = 0  # characters of `lines`

    def matrix(self, words: list[bytes]) -> list[bytes]:
        """Ids (as int32 bytes) of words of similar length."""
        n = np.array([len(w) for w in words])
        width = int(n.max())
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width)[None, :] < n[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        out: list[bytes] = [b""] * len(words)
        row = np.arange(len(words))
        rank = self.table.find(ids[:, :-1], ids[:, 1:])
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                for r, x in zip(row[done].tolist(), ids[done]):
                    out[r] = x[x >= 0].tobytes()
                on = ~done
                row, ids, rank, at, best = row[on], ids[on], rank[on], at[on], best[on]
                if not row.size:
                    return out
                if (used := int((ids >= 0).sum(axis=1).max())) < ids.shape[1]:
                    ids, rank = ids[:, :used], rank[:, : used - 1]
            i, w = np.arange(len(row)), ids.shape[1]
            ids[i, at] = best
            move = np.arange(w)[None, :] > at[:, None]  # what follows the merged pair moves up by one
            from_ = np.minimum(np.arange(w)[None, :] + move, w - 1)
            ids = np.take_along_axis(ids, from_, 1)
            ids[:, -1][at < w - 1] = -1
            rank = np.take_along_axis(rank, from_[:, : w - 1].clip(max=w - 2), 1)
            rank[:, -1] = NONE
            before = np.maximum(at - 1, 0)
            rank[i, before] = self.table.find(ids[i, before], ids[i, before + 1])
            here = np.minimum(at, w - 2)
            rank[i, here] = self.table.find(ids[i, here], ids[i, here + 1])

    def heap(self, word: bytes) -> bytes:
        """Ids of one long word: pairs in a heap by rank and place, neighbours in linked lists."""
        ids = [self.byte_list[b] for b in word]
        size = len(ids)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [(r, i) for i in range(size - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if ids[i] >= 0 else size
            if j >= size or self.pairs.get((ids[i], ids[j])) != r:
                continue  # one of the two has been merged since
            ids[i], ids[j], right[i] = r, -1, right[j]
            if right[j] < size:
                left[right[j]] = i
                if (x := self.pairs.get((r, ids[right[j]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if left[i] >= 0 and (x := self.pairs.get((ids[left[i]], r))) is not None:
                heapq.heappush(heap, (x, left[i]))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode words, which are not in the cache, into it, in buckets of similar length."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode()
            if len(b) > LONGEST:
                self.words[w] = self.heap(b)
            else:
                buckets.setdefault((len(b) - 1).bit_length(), []).append((w, b))
        for k, group in buckets.items():
            step = max(1, CELLS >> k)
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                self.words.update(zip((w for w, _ in part), self.matrix([b for _, b in part])))

    def learn_words(self, words: set[str]) -> None:
        """Have all these words in the cache."""
        new = words.difference(self.words)
        if len(self.words) + len(new) > CACHE:
            self.words.clear()
            new = words
        self.learn(new)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as int32 bytes; nothing for null and empty texts. Words are learned for many texts at once."""
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < TOGETHER):
                size += len(texts[hi] or "")
                hi += 1
            split = [lines(t) if t else [] for t in texts[lo:hi]]
            fresh = list(set().union(*split).difference(self.lines))
            words = [self.split_ascii(x) if x.isascii() else self.split(x) for x in fresh]
            self.learn_words(set().union(*words))
            own = dict(zip(fresh, [b"".join(map(self.words.__getitem__, ws)) for ws in words]))
            size = sum(map(len, fresh))
            if self.kept + size > LINES and fresh:
                known = set().union(*split).intersection(self.lines)
                own.update((x, self.lines[x]) for x in known)  # what this batch needs
                self.lines, self.kept = own, sum(map(len, own))
            else:
                self.lines.update(own)
                self.kept += size
            out += [b"".join(map(self.lines.__getitem__, xs)) for xs in split]
            lo = hi
        return out


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """The worker's encoder of a vocabulary, built once a process."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _tokens(df: DataFrame, text: str, keep: list[str], out: str, make, tokenizers: str, vocabulary: str) -> DataFrame:
    file = df.sparkSession.sparkContext.broadcast(Path(tokenizers, vocabulary).read_bytes())  # a fixed file under 1 MB
    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text).cast("string").alias("t"))
    schema = ", ".join([*(f"{n} {source.schema[n].dataType.simpleString()}" for n in names), f"x {out}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], make(enc, b.column(len(names)).to_pylist())], names=[*names, "x"])

    return spread(source).mapInArrow(run, schema).select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "x")


def _lists(enc: Encoder, texts: list[str | None]) -> pa.Array:
    found = enc.encode(texts)
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _sizes(enc: Encoder, texts: list[str | None]) -> pa.Array:
    return pa.array([len(x) // 4 for x in enc.encode(texts)], pa.int64())


def encode(df: DataFrame, text: str, keep: list[str], ids: str = "ids", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns of every row and `ids`, the text's token ids without special tokens (array<int>).

    Null and empty texts give the empty list; blank ones are encoded as they are, and strings of special tokens are
    ordinary text. Texts of any length are encoded whole. Repeated rows stay, an empty table gives no rows. `ids` gets an
    underscore where a kept column has that name. `tokenizers` is the folder of the vocabulary files."""
    return _tokens(df, text, keep, "array<int>", _lists, tokenizers, vocabulary).withColumnRenamed("x", free_name(ids, keep))


def count_tokens(df: DataFrame, text: str, keep: list[str], n: str = "n_tokens", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """As `encode`, but only the number of tokens (bigint)."""
    return _tokens(df, text, keep, "bigint", _sizes, tokenizers, vocabulary).withColumnRenamed("x", free_name(n, keep))
