"""A full-text index over word codes: sorted suffixes, wavelet ranks and sampled positions, built with numpy.

Code 0 is a separator: no pattern holds it, and no two separators compare as equal. The text must end with one.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions one is kept for locating; so are those that follow a separator.
SAMPLE = 16

U64 = np.uint64


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only suffixes that are still tied are sorted again.

    The first separators in the text are the smallest symbols.
    """
    n = len(text)
    breaks = text == 0
    n_breaks = int(breaks.sum())
    keys = text.astype(np.int64) + n_breaks
    keys[breaks] = np.arange(n_breaks)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)

    def ranked(at: np.ndarray, suffixes: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Give each suffix the place of the first of its group; return what is still tied."""
        head = np.ones(len(at), bool)
        head[1:] = sorted_keys[1:] != sorted_keys[:-1]
        heads = np.flatnonzero(head)
        rank[suffixes] = np.repeat(at[heads], np.diff(np.append(heads, len(at))))
        tied = ~(head & np.append(head[1:], True))
        return at[tied], suffixes[tied]

    at, suffixes = ranked(np.arange(n), order, keys[order])
    width = 1
    while len(at):
        pair = (rank[suffixes] << 32) | rank[suffixes + width]
        by_pair = np.argsort(pair, kind="stable")
        suffixes = suffixes[by_pair]
        order[at] = suffixes
        at, suffixes = ranked(at, suffixes, pair[by_pair])
        width *= 2
    return order


class Bits:
    """A bit vector with constant-time counts of ones."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, U64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, low = i >> 6, (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(U64)) & U64(1) != 0


class WaveletMatrix:
    """Ranks of symbols below ``2 ** levels``: one bit vector per binary digit, highest first."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.bits, self.zeros = [], []
        for shift in range(self.levels - 1, -1, -1):
            one = (symbols >> shift) & 1 != 0
            self.bits.append(Bits(one))
            symbols = np.concatenate([symbols[~one], symbols[one]])
            self.zeros.append(len(symbols) - int(one.sum()))
        self.base = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (symbols >> (self.levels - 1 - k)) & 1 != 0
            ones = bits.ones(i)
            i = np.where(one, zeros + ones, i - ones)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position i."""
        return self._down(symbols, i) - self.base[symbols]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its occurrences before."""
        symbols = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one, ones = bits.at(i), bits.ones(i)
            symbols = symbols * 2 + one
            i = np.where(one, zeros + ones, i - ones)
        return symbols, i - self.base[symbols]


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        order = suffix_array(text)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        last = text[order - 1]
        self.wavelet = WaveletMatrix(last, n_symbols)
        kept = (order % SAMPLE == 0) | (last == 0)
        self.sampled = Bits(kept)
        self.positions = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the patterns that occur, and their numbers. Patterns are aligned at the right."""
        width = patterns.shape[1]
        live = np.flatnonzero(lengths > 0)
        symbols = patterns[live, width - 1]
        low, high = self.smaller[symbols], self.smaller[symbols + 1]
        live, low, high = (x[low < high] for x in (live, low, high))
        for column in range(width - 2, -1, -1):
            going = lengths[live] >= width - column
            symbols = patterns[live[going], column]
            low[going] = self.smaller[symbols] + self.wavelet.rank(symbols, low[going])
            high[going] = self.smaller[symbols] + self.wavelet.rank(symbols, high[going])
            live, low, high = (x[low < high] for x in (live, low, high))
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: step back until a sampled position."""
        out = np.empty(len(rows), np.int64)
        waiting, steps = np.arange(len(rows)), 0
        while len(waiting):
            there = self.sampled.at(rows)
            out[waiting[there]] = self.positions[self.sampled.ones(rows[there])] + steps
            waiting, rows = waiting[~there], rows[~there]
            symbols, before = self.wavelet.symbol_and_rank(rows)
            rows, steps = self.smaller[symbols] + before, steps + 1
        return out
