"""Whole batches of texts as one byte array: folding, words, hashes and shingles with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLANK, END = 0x20, 0x0A
#: Texts are worked on in groups of about so many bytes; a longer text is a group of its own.
CHUNK = 1 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 512

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[9:14] = BLANK
_FOLD[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def scramble(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with the texts' UTF-8 bytes (null: empty), each of about CHUNK bytes."""
    col = batch.column(column).cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
        yield batch.slice(at, to - at), col.slice(at, to - at).to_pylist()
        at = to


class Words:
    """Folded texts of a chunk: words one blank apart, a line end after each text.

    bytes: all of it, with 8 bytes of padding; ends: where each text's line end is; first, last: each word's start
    and the byte after it; text_of: the text each word is in; counts: words of each text.
    """

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        c = _FOLD[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)] if texts else np.zeros(0, np.uint8)
        c[np.cumsum(sizes + 1) - 1] = END
        blank = c == BLANK
        edge = blank | (c == END)
        blank[1:] &= edge[:-1]
        c = c[~blank]
        last = np.zeros(len(c), dtype=bool)
        last[:-1] = (c[:-1] == BLANK) & (c[1:] == END)
        c = c[~last]
        self.n = len(texts)
        self.bytes = np.concatenate([c, np.zeros(8, np.uint8)])
        self.ends = np.flatnonzero(c == END)
        stop = np.flatnonzero((c == BLANK) | (c == END))
        start = np.concatenate([np.zeros(1, np.int64), stop[:-1] + 1])[: len(stop)]
        real = stop > start
        self.first, self.last = start[real], stop[real]
        self.text_of = np.searchsorted(self.ends, self.first)
        self.counts = np.bincount(self.text_of, minlength=self.n)

    def eights(self) -> np.ndarray:
        """At every byte, it and the next seven as one little-endian number (a view)."""
        return np.ndarray(shape=(len(self.bytes) - 7,), dtype="<u8", buffer=self.bytes.data, strides=(1,))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        size, lanes = self.last - self.first, self.eights()
        h = scramble(size.astype(U64) + U64(0x9E3779B97F4A7C15))
        todo, at = np.arange(len(size)), 0
        while len(todo):
            part = lanes[self.first[todo] + at] & _MASKS[np.minimum(size[todo] - at, 8)]
            h[todo] = scramble(h[todo] ^ part)
            at += 8
            todo = todo[size[todo] > at]
            if at >= LONG_WORD:
                for i in todo:
                    h[i] = U64(int.from_bytes(hashlib.blake2b(self.bytes[self.first[i] : self.last[i]].tobytes(), digest_size=8).digest(), "little"))
                break
        return h

    def shingles(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes of each text, sorted, one text after the other, and where each text's begin (n + 1 numbers).

        A text with fewer words has one shingle, its whole sequence; a text without words has none.
        """
        h = self.hashes()
        run = np.zeros(max(0, len(h) - words + 1), dtype=U64)
        for k in range(words):
            run = scramble(run * U64(0x9E3779B97F4A7C15) + h[k : len(h) - words + 1 + k]) if len(run) else run
        begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.counts)])
        parts, sizes = [], np.zeros(self.n, dtype=np.int64)
        for i in range(self.n):
            a, b = begin[i], begin[i + 1]
            if b - a >= words:
                s = np.sort(run[a : b - words + 1])
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                s = np.full(1, b - a, dtype=U64)
                for x in h[a:b]:
                    s = scramble(s * U64(0x9E3779B97F4A7C15) + x)
            else:
                continue
            parts.append(s)
            sizes[i] = len(s)
        return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
