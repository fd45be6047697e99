"""An FM-index over word symbols: wavelet matrix, backward search, matching statistics.

The text is a run of segments, each followed by symbol 0.  Suffixes are sorted by their first
`depth` symbols, which is all that patterns of up to `depth` symbols need: intervals follow from
counts alone.  The index keeps the Burrows-Wheeler transform as packed bits with one count per 64,
the symbol counts, and per interval of depth symbols the least order number of its positions.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.zeros(len(bits) // 64 + 1, np.uint64)
        raw = np.packbits(bits, bitorder="little")
        packed.view(np.uint8)[:len(raw)] = raw
        self.words = packed
        self.before = np.zeros(len(packed) + 1, np.int32)
        np.cumsum(np.bitwise_count(packed), out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """A wavelet matrix: rank of any symbol in two bit ranks per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels: list[Bits] = []
        self.shifts = list(range(max(1, int(n_symbols - 1).bit_length())))[::-1]
        now = symbols
        for shift in self.shifts:
            bit = (now >> shift) & 1 == 1
            self.levels.append(Bits(bit))
            now = np.concatenate([now[~bit], now[bit]])
        self.first = np.zeros(n_symbols, np.int64)  # where each symbol's run begins below
        present, at = np.unique(now, return_index=True)
        self.first[present] = at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        for shift, level in zip(self.shifts, self.levels):
            ones = level.rank(at)
            at = np.where((symbols >> shift) & 1 == 1, level.zeros + ones, at - ones)
        return at - self.first[symbols]


class FMIndex:
    def __init__(self, text: np.ndarray, order: np.ndarray, n_symbols: int, depth: int) -> None:
        """`text`: symbols below n_symbols, 0 ends a segment; `order`: a number per position,
        the least of an interval is kept."""
        n, self.depth = len(text), depth
        rank, reach = text.astype(np.int64), 1
        while reach * 2 < depth:  # ranks by the first 2, 4, 8, ... symbols
            rank = _rank(_pair(rank, reach))
            reach *= 2
        key = _pair(rank, depth - reach)  # two overlapping runs of `reach` symbols
        suffixes = np.argsort(key)  # ties share their first `depth` symbols; any order does
        self.wavelet = Wavelet(text[suffixes - 1], n_symbols)
        self.count = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=n_symbols), out=self.count[1:])
        self.whole = _Groups(key[suffixes])
        self.shorter = _Groups(_pair(rank, depth - 1 - reach)[suffixes])
        self.least = np.minimum.reduceat(order[suffixes], self.whole.starts[:-1])

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Backward search: the intervals of `symbol + pattern` from those of the patterns."""
        both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        base = self.count[symbols]
        return base + both[:len(lo)], base + both[len(lo):]

    def statistics(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Matching statistics of segments of the indexed text, capped at `depth`.

        Returns segment, place and least order number of every run of `depth` symbols.  All
        segments are read from right to left at once.  A match that has reached the depth is
        shortened at its right end to depth - 1 before it grows to the left.  As the segments are
        parts of the text, a match never fails before."""
        live = np.arange(len(starts))
        at, lo = ends - 1, np.zeros(len(starts), np.int64)
        hi, length = np.full(len(starts), len(text), np.int64), 0
        found = []
        while len(live):
            if length == self.depth:
                group = self.shorter.of[lo]
                lo, hi = self.shorter.starts[group], self.shorter.starts[group + 1]
                length -= 1
            lo, hi = self.extend(text[at], lo, hi)
            length += 1
            if length == self.depth:
                found.append((live, at, self.least[self.whole.of[lo]]))
            at = at - 1
            more = at >= starts[live]
            live, at, lo, hi = live[more], at[more], lo[more], hi[more]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(map(np.concatenate, zip(*found)))


class _Groups:
    """Runs of equal keys in sorted order."""

    def __init__(self, keys: np.ndarray) -> None:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.of = np.cumsum(new) - 1
        self.starts = np.append(np.flatnonzero(new), len(keys))


def _pair(rank: np.ndarray, step: int) -> np.ndarray:
    following = np.zeros_like(rank)
    if step:
        following[:len(rank) - step] = rank[step:]
        return rank * (int(rank.max()) + 1) + following
    return rank


def _rank(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    out = np.empty(len(key), np.int64)
    out[order] = _Groups(key[order]).of
    return out + 1  # 0 is past the end
