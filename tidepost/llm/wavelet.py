"""A wavelet matrix over small classes of many texts at once: rank and select by whole arrays.

Position ``i`` of the joined texts has a class below ``2 ** BITS``. Level by level, from the
highest bit, positions are parted into zeros first and ones after, in order. ``rank`` follows a
place down the levels through running counts of ones; ``select`` bisects on ranks, which also
works for sets of classes.
"""

from __future__ import annotations

import numpy as np

BITS = 3
BLOCK = 64


class WaveletMatrix:
    def __init__(self, classes: np.ndarray):
        self.size = len(classes)
        self.levels = []
        own = classes.astype(np.uint8)
        for bit in range(BITS - 1, -1, -1):
            ones = (own >> bit) & 1
            words = np.packbits(ones, bitorder="little")
            words = np.concatenate([words, np.zeros(-len(words) % 8 + 8, dtype=np.uint8)]).view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((words, before, self.size - int(ones.sum())))
            own = np.concatenate([own[ones == 0], own[ones == 1]])

    def _ones(self, level: int, place: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        block, rest = place // BLOCK, (place % BLOCK).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & mask)

    def rank(self, symbol: int, place: np.ndarray) -> np.ndarray:
        """Positions below each ``place`` whose class is ``symbol``."""
        start, end = np.zeros_like(place), place
        for level in range(BITS):
            zeros = self.levels[level][2]
            if symbol >> (BITS - 1 - level) & 1:
                start, end = zeros + self._ones(level, start), zeros + self._ones(level, end)
            else:
                start, end = start - self._ones(level, start), end - self._ones(level, end)
        return end - start

    def count(self, symbols: tuple[int, ...], place: np.ndarray) -> np.ndarray:
        """Positions below each ``place`` whose class is one of ``symbols``."""
        return sum((self.rank(s, place) for s in symbols), np.zeros_like(place))

    def select(self, symbols: tuple[int, ...], number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place just behind the ``number``-th (from 1, over all texts) position of ``symbols``, known to be in (low, high]."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high) // 2
            enough = self.count(symbols, middle) >= number
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low
