"""A compressed FM-index over words, in numpy: context-sorted BWT in a wavelet
matrix of packed bits, with bit-vector rank. Searches run for many streams at
once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, flags: np.ndarray):
        padded = np.zeros((len(flags) // 64 + 1) * 64, np.uint8)
        padded[:len(flags)] = flags
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at >> 6
        part = self.blocks[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(part)


def context_ranks(text: np.ndarray, width: int) -> np.ndarray:
    """For each position the rank of the ``width`` symbols that begin there
    (0 past the end), by doubling the sorted width."""
    rank, have = text.astype(np.int64), 1
    while have < width:
        step = min(have, width - have)
        later = np.zeros(len(rank), np.int64)
        later[:len(rank) - step] = rank[step:]
        key = rank * (int(rank.max(initial=0)) + 1) + later
        order = np.argsort(key)
        ranked = key[order]
        new = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
        rank = np.empty(len(key), np.int64)
        rank[order] = new
        have += step
    return rank


class FMIndex:
    """Index of a text of word numbers (0 parts the segments) for patterns of up
    to ``width`` words.

    Suffixes are sorted by their first ``width`` words, then by place. That is
    enough for backward search up to that length: whether a suffix lies before
    the interval of a shorter pattern does not depend on more."""

    def __init__(self, text: np.ndarray, width: int, place: np.ndarray | None = None):
        self.width, n = width, len(text)
        self.place = np.arange(n) if place is None else place  # of each word, in the order that counts as earlier
        rank = context_ranks(text, width)
        suffixes = np.argsort(rank, kind="stable")
        sorted_rank = rank[suffixes]
        # classes of equal contexts, as bits at their first suffix, and the earliest place of each
        first = np.append(True, sorted_rank[1:] != sorted_rank[:-1]) if n else np.zeros(0, bool)
        self.full = Bits(first)
        self.earliest = np.minimum.reduceat(self.place[suffixes], np.flatnonzero(first)) if n else np.zeros(0, np.int64)
        del rank, sorted_rank
        # the same for contexts one word shorter: neighbours differ there, or not
        differ = self._differ(text, suffixes, first, width - 1)
        self.short = Bits(differ)
        self.short_starts = np.append(np.flatnonzero(differ), n)
        bwt = text[suffixes - 1]  # the suffix at 0 is preceded by the last symbol, a separator
        symbols = int(text.max(initial=0)) + 1
        self.levels = max(1, (symbols - 1).bit_length())
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.size = n
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            flags = (bwt >> level) & 1
            self.bits.append(Bits(flags.astype(np.uint8)))
            self.zeros.append(int(n - flags.sum()))
            bwt = np.concatenate([bwt[flags == 0], bwt[flags == 1]])
        self.begin = self._down(np.zeros(symbols, np.int64), np.arange(symbols))

    @staticmethod
    def _differ(text: np.ndarray, suffixes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
        """Whether a suffix differs from the one before it within ``width`` words."""
        out = first.copy()
        at = np.flatnonzero(first)
        at = at[at > 0]
        if len(at):
            a, b = suffixes[at - 1], suffixes[at]
            same = np.ones(len(at), bool)
            padded = np.append(text, np.zeros(width, text.dtype))
            for i in range(width):
                same &= padded[a + i] == padded[b + i]
            out[at[same]] = False
        return out

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Positions followed through the wavelet matrix along symbols."""
        for i, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.levels - 1 - i)) & 1, zeros + ones, at - ones)
        return at

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern, from those of the patterns."""
        n = len(low)
        down = self._down(np.concatenate([low, high]), np.concatenate([symbol, symbol]))
        shift = self.smaller[symbol] - self.begin[symbol]
        return down[:n] + shift, down[n:] + shift

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns of full width after their last word is dropped."""
        k = self.short.rank(low + 1) - 1
        return self.short_starts[k], self.short_starts[k + 1]

    def first_place(self, low: np.ndarray) -> np.ndarray:
        """The earliest place of patterns of full width, from their intervals' low ends."""
        return self.earliest[self.full.rank(low + 1) - 1]


def repeated(index: FMIndex, text: np.ndarray, starts: np.ndarray, counts: np.ndarray, piece: int = 64) -> np.ndarray:
    """Which of the windows begin earlier in the text too. Segment i has the
    windows that begin at starts[i] ... starts[i] + counts[i] - 1.

    Segments are streamed right to left, cut into pieces of at most ``piece``
    windows, all pieces in step: matching statistics capped at the window
    width. A word extends the match; once it is full its interval tells the
    earliest place, then the last word is dropped."""
    width = index.width
    pieces = (counts + piece - 1) // piece
    own = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[own] + nth * piece
    windows = np.minimum(counts[own] - nth * piece, piece)
    order = np.argsort(-windows, kind="stable")
    begin, windows = begin[order], windows[order]
    at = begin + windows + width - 2  # the last word of the last window
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), index.size)
    found = np.zeros(len(text), bool)
    for step in range(int(windows.max(initial=0)) + width - 1):
        active = int(np.searchsorted(-windows, -(step - width + 2), side="right")) if step >= width else len(windows)
        at, low, high = at[:active], low[:active], high[:active]
        low, high = index.extend(low, high, text[at])
        if step >= width - 1:
            found[at] = index.first_place(low) < index.place[at]
            low, high = index.shorten(low)
        at = at - 1
    return found
