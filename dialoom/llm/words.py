"""Vectorised word tables of text blocks, shared by the operators that hash words, lines or shingles.

Texts are UTF-8 bytes. A block is a run of whole texts joined by newlines; words are maximal runs of
bytes other than space and 0x09-0x0D. A word's hash is a polynomial over its bytes modulo 2**64, read
off prefix sums, so a block costs a few numpy passes and no Python loop over words. Such a polynomial is weak on long
texts (Thue-Morse words of 1,024 letters have one value whatever the base), so what is longer than ``LONG`` bytes is
hashed by its bytes instead: at most one call for each ``LONG`` bytes of a block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

BLOCK, LONG = 1 << 20, 256
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK + (1 << 16))
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, r, np.uint64)]) for r in (_R, _RINV)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_long(h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """h, with the hashes of long stretches of data by their bytes; data: of bytes or code points."""
    for i in np.flatnonzero(end - start > LONG):
        h[i] = xxhash.xxh64_intdigest(np.ascontiguousarray(data[start[i] : end[i]]).view(np.uint8))
    return h


def blocks(texts: Iterable[str | bytes | None], limit: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) of consecutive blocks of about ``limit`` bytes; null is empty."""
    got: list[bytes] = []
    size = first = i = 0
    for i, t in enumerate(texts):
        b = t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if got and size + len(b) > limit:
            yield first, got
            got, size, first = [], 0, i
        got.append(b)
        size += len(b) + 1
    if got:
        yield first, got


class Block:
    """Byte buffer of a block with its words: start, end (byte offsets), doc (index in the block), h (hash)."""

    def __init__(self, texts: list[bytes], lower: bool = False, separators: np.ndarray = SPACE):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.doc_end = np.cumsum(sizes)
        self.doc_start = self.doc_end - sizes
        data = LOWER[self.buf] if lower else self.buf
        self.data = data
        out = separators[self.buf]
        edge = np.flatnonzero(np.diff(np.r_[True, out].astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        power, self._inverse = powers(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.prefix[1:])
        self.h = self.hash(self.start, self.end)
        self.doc = np.searchsorted(self.doc_end, self.start, "right")
        self.word_end = np.searchsorted(self.doc, np.arange(self.n), "right")
        self.word_start = np.searchsorted(self.doc, np.arange(self.n), "left")

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return with_long(mix((self.prefix[end] - self.prefix[start]) * self._inverse[start]), self.data, start, end)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.doc_end] - total[self.doc_start]

    def shingles(self, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, index of first word, hash) of all runs of n words; a text of 1 to n-1 words is one shingle."""
        h, m = self.h, max(0, len(self.h) - n + 1)
        acc = np.zeros(m, np.uint64)
        for k in range(n):
            acc = mix(acc + h[k : k + m] + np.uint64(k + 1))
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 : n - 1 + m]) if m else np.zeros(0, np.int64)
        doc, first, acc = self.doc[at], at, acc[at]
        if whole_if_short:
            count = self.word_end - self.word_start
            for d in np.flatnonzero((count > 0) & (count < n)):
                x = np.zeros(1, np.uint64)
                for k in range(count[d]):
                    x = mix(x + h[self.word_start[d] + k] + np.uint64(k + 1))
                x = mix(x + np.uint64(1 << 40) + np.uint64(count[d]))
                doc, first, acc = np.r_[doc, d], np.r_[first, self.word_start[d]], np.r_[acc, x]
        return doc, first, acc


def distinct(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, key) pairs ordered by doc, then key."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    if len(key) > 1:
        new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
        doc, key = doc[new], key[new]
    return doc, key
