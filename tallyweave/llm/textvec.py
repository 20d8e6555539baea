"""Words of many texts at once, as NumPy arrays over the Arrow buffer that holds the texts.

Both word definitions of this package are unions of byte classes (every byte of a non-ASCII character is a word
byte in both), so words of UTF-8 text are found bytewise. A word's 64-bit hash is a polynomial over its lower-cased
bytes; windows of words are hashed from the words' hashes. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(n, b, U64))]) for b in (_BASE, _BASE_INV))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of MurmurHash3)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U64(33))
        x = x * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


@dataclass
class Words:
    """Words of the rows first..last: byte ranges in ``data``, row (from 0 at ``first``), hash; ``at`` has each row's first word."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    at: np.ndarray

    def text(self, i: int, n: int = 1) -> bytes:
        """Words i..i+n-1, lower-cased, joined by a space."""
        return b" ".join(LOWER[self.data[s:e]].tobytes() for s, e in zip(self.start[i : i + n], self.end[i : i + n], strict=True))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and each row's offsets into them."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes (a longer text comes alone): first row, end row, bytes, offsets."""
    data, offs = text_buffers(texts)
    n, first = len(texts), 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def words_of(first: int, last: int, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray, lower: bool = True) -> Words:
    n = len(data)
    inside = is_word[data]
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, inside
    before[offs] = False
    start = np.flatnonzero(inside & ~before[:n])
    after = np.empty(n + 1, bool)
    after[n], after[:n] = False, inside
    after[offs] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    row = np.searchsorted(offs, start, side="right") - 1
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum(((LOWER[data] if lower else data).astype(U64) + U64(1)) * up[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
    at = np.searchsorted(row, np.arange(last - first + 1), side="left")
    return Words(first, last, data, offs, start, end, row, h, at)


def words(texts: pa.Array, is_word: np.ndarray, lower: bool = True, most: int = 1 << 20) -> Iterator[Words]:
    for part in slices(texts, most):
        yield words_of(*part, is_word, lower)


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of n consecutive words of one row."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    i = np.flatnonzero(w.row[:m] == w.row[n - 1 :])
    return i, mix(combine(w.hash, i, n))


def combine(h: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    up, down = powers(len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, U64)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        return (sums[i + n] - sums[i]) * down[i] + U64(n * 0x1F3D)
