"""Words of whole texts as byte positions and 64-bit hashes, in numpy.

Both word classes used here are closed under UTF-8: every byte of a non-ASCII character is a
word byte, so words can be cut on bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PIECE = 1 << 20  # bytes hashed at once; pieces end between words

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
NOT_SPACE = np.ones(256, bool)  # [^\x20\x09-\x0D]
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Hasher:
    """Hashes of runs of codes from prefix sums; the powers are kept between calls."""

    def __init__(self) -> None:
        self.up = powers(BASE, 0)
        self.down = powers(BASE_INVERSE, 0)

    def runs(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(codes)
        if len(self.up) < n + 1:
            self.up, self.down = powers(BASE, n + 1), powers(BASE_INVERSE, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.up[:n], out=sums[1:])
        # the length goes in as well
        return mix((sums[ends] - sums[starts]) * self.down[starts]
                   + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    data: np.ndarray     # bytes, lower-cased if asked
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray   # one per word
    first: np.ndarray    # index of each row's first word, plus the end
    offsets: np.ndarray  # first byte of each row, plus the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, word: int) -> bytes:
        return self.data[self.starts[word]:self.ends[word]].tobytes()

    def joined(self, word: int, n: int) -> bytes:
        """n words joined by one space."""
        cuts = zip(self.starts[word:word + n].tolist(), self.ends[word:word + n].tolist())
        return b" ".join([self.data[a:b].tobytes() for a, b in cuts])


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool,
          hasher: Hasher | None) -> Words:
    """Words of all rows, with hashes if a hasher is given.  Rows are given by their offsets."""
    if lower:
        data = LOWER[data]
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(0, np.uint64),
                     np.zeros(len(offsets), np.int64), offsets)
    inside = word_bytes[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    lo = 0 if hasher else len(starts)
    while lo < len(starts):  # pieces bound the memory for one very long row
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        hashes[lo:hi] = hasher.runs(BYTE_CODE[data[base:ends[hi - 1]]],
                                    starts[lo:hi] - base, ends[lo:hi] - base)
        lo = hi
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets).astype(np.int64),
                 offsets)


def window_starts(w: Words, size: int) -> np.ndarray:
    """First word of every run of `size` consecutive words of one row."""
    total = len(w.starts)
    left = np.repeat(w.first[1:], w.counts()) - np.arange(total)  # words from here to the row's end
    return np.flatnonzero(left >= size)


def windows(w: Words, size: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of `size` consecutive words of one row."""
    at = window_starts(w, size)
    return at, hasher.runs(w.hashes, at, at + size)
