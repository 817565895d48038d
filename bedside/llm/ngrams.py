"""Hashed byte n-grams of words, summed from a table of values without a loop over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from . import words


def _marked(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in ws), dtype=np.uint8)
    end = np.cumsum(np.fromiter((len(w) + 2 for w in ws), dtype=np.int64, count=len(ws)))
    start = np.concatenate([[0], end[:-1]]) if len(ws) else end
    return data, start, end


def _hashes(data: np.ndarray, n: int, buckets: int) -> np.ndarray:
    weights, powers, m = words._WEIGHTS, words.powers(n), len(data) - n + 1
    total = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        total += weights[data[k : k + m]] * powers[k]
    return (words.mix(total) & np.uint64(buckets - 1)).astype(np.int64)


def entries(ws: list[bytes], sizes: Iterable[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of every n-gram of the words with borders marked, in order of the words."""
    data, start, end = _marked(ws)
    owner = np.repeat(np.arange(len(ws)), end - start)
    found = []
    for n in sizes:
        if len(data) >= n:
            h = _hashes(data, n, buckets)
            fits = owner[: len(h)] == owner[n - 1 :]
            found.append((owner[: len(h)][fits], h[fits]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    word = np.concatenate([w for w, _ in found])
    order = np.argsort(word, kind="stable")
    return word[order], np.concatenate([h for _, h in found])[order]


def sums(ws: list[bytes], table: np.ndarray, sizes: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of ``table`` rows (buckets x k) over each word's n-grams, and their number."""
    data, start, end = _marked(ws)
    total = np.zeros((len(ws), table.shape[1]))
    count = np.zeros(len(ws))
    for n in sizes:
        stop = np.maximum(end - n + 1, start)
        count += stop - start
        if len(data) >= n:
            running = np.zeros((len(data) - n + 2, table.shape[1]))
            np.cumsum(table[_hashes(data, n, len(table))], axis=0, out=running[1:])
            stop, begin = np.minimum(stop, len(running) - 1), np.minimum(start, len(running) - 1)
            total += running[stop] - running[begin]
    return total, count


class WordValues:
    """Values of words, computed once per distinct word and kept up to ``limit`` words."""

    def __init__(self, table: np.ndarray, sizes: tuple[int, ...], limit: int = 200_000):
        self._table, self._sizes, self._limit = table, sizes, limit
        self._known: dict[str, int] = {}
        self._values = np.zeros((0, table.shape[1]), dtype=np.float32)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """Row of each token in ``values``; valid until the next call."""
        known = self._known
        new = [w for w in dict.fromkeys(tokens) if w not in known]
        if new:
            if len(known) + len(new) > self._limit:
                known.clear()
                self._values = self._values[:0]
                new = list(dict.fromkeys(tokens))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            fresh = [self._values]
            for part in words.pieces([len(w) for w in new], 1 << 18):
                total, count = sums(words.encoded(new[part]), self._table, self._sizes)
                fresh.append((total / np.maximum(count, 1)[:, None]).astype(np.float32))
            self._values = np.concatenate(fresh)
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    @property
    def values(self) -> np.ndarray:
        return self._values


def batches(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    for part in words.pieces([len(t) for t in texts], limit):
        yield texts[part]
