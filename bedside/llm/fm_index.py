"""FM-index over sequences of numbers, with a wavelet matrix for rank and lock-step backward search (numpy)."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling. Separators in ``text`` are all different, so few rounds do."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while n > 1 and rank[order[-1]] < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        step *= 2
    return order


class WaveletMatrix:
    """Rank of a symbol in a prefix, in one packed bit vector a bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self._words, self._ones, self._zeros = [], [], []
        n = len(symbols)
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            padded = np.zeros((len(packed) // 8 + 1) * 8, dtype=np.uint8)
            padded[: len(packed)] = packed
            words = padded.view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)
            self._words.append(words)
            self._ones.append(ones)
            self._zeros.append(n - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        start = np.zeros(len(at), dtype=np.int64)
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            both = np.concatenate([start, at])
            word = both >> 6
            mask = (np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1)
            ones = self._ones[i][word] + np.bitwise_count(self._words[i][word] & mask).astype(np.int64)
            half = len(at)
            start = np.where(one, self._zeros[i] + ones[:half], start - ones[:half])
            at = np.where(one, self._zeros[i] + ones[half:], at - ones[half:])
        return at - start


class FMIndex:
    """Index of several sequences (numbers from 1), each closed by a separator of its own."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray):
        """``sequences``: all numbers one after the other; ``lengths``: of each sequence."""
        m, n = len(lengths), len(sequences) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(n, dtype=bool)
        inside[ends] = False
        text = np.zeros(n, dtype=np.int64)
        text[inside] = sequences
        unique = text + m
        unique[ends] = np.arange(m)
        self.text, self.inside, self.order = text, inside, suffix_array(unique)
        before = text[self.order - 1]  # of the first suffix: the last separator
        alphabet = int(sequences.max(initial=0)) + 1
        self._rank = WaveletMatrix(before, alphabet)
        self._less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])

    def matching_statistics(self, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end position in the text (exclusive): how far to its left, up to ``longest`` words, the words occur elsewhere too.

        All positions are searched backwards in lock step. A position stops when its interval holds itself alone or
        a sequence begins. Returns the lengths and the suffix intervals of those that reached ``longest``.
        """
        n = len(ends)
        length = np.zeros(n, dtype=np.int64)
        low, high = np.zeros(n, dtype=np.int64), np.full(n, len(self.text), dtype=np.int64)
        live = np.arange(n)
        for k in range(1, longest + 1):
            at = ends[live] - k
            live = live[(at >= 0) & self.inside[np.maximum(at, 0)]]
            symbol = self.text[ends[live] - k]
            if k == 1:
                lo, hi = self._less[symbol], self._less[symbol + 1]
            else:
                lo = self._less[symbol] + self._rank.rank(symbol, low[live])
                hi = self._less[symbol] + self._rank.rank(symbol, high[live])
            low[live], high[live] = lo, hi
            live = live[hi - lo > 1]
            length[live] = k
        return length, low, high

    def first_place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least text position in each suffix interval."""
        if not len(low):
            return low
        pairs = np.unique(np.stack([low, high], axis=1), axis=0)  # equally long matches: equal or disjoint
        cuts = pairs.ravel()
        padded = np.append(self.order, len(self.order))
        least = np.minimum.reduceat(padded, cuts)[::2]
        return least[np.searchsorted(pairs[:, 0], low)]
