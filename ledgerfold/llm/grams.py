"""Hashed character n-grams of one text, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class CharGrams:
    """Hashes the character n-grams of a text into 2**bits buckets.

    Letters are lower-cased and each run of white space is one space; a space stands at both ends.
    A long text is hashed in overlapping windows: besides the text's own code points (four bytes each), memory
    doesn't grow with it.
    """

    def __init__(self, orders: tuple[int, ...], bits: int, window: int = 1 << 18):
        self.orders, self.bits, self.window = tuple(sorted(orders)), bits, window
        self._seen = np.zeros(1 << bits, dtype=bool)

    def ids(self, text: str) -> Iterator[np.ndarray]:
        """Bucket numbers of all n-grams, window by window."""
        points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        longest = self.orders[-1]
        for start in range(0, len(points), self.window):
            part = points[start : start + self.window + longest - 1]
            own = min(self.window, len(points) - start)
            spread = part * np.uint32(0x9E3779B1)
            state = spread ^ (spread >> np.uint32(15))
            for n in range(1, longest + 1):
                if n > 1:
                    if len(part) < n:
                        break
                    state = state[:-1] * np.uint32(0x85EBCA6B) + spread[n - 1 :]
                    state ^= state >> np.uint32(13)
                if n in self.orders:
                    mixed = (state[:own] ^ np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
                    yield (mixed >> np.uint32(32 - self.bits)).astype(np.int32)

    def present(self, text: str) -> np.ndarray:
        """The buckets that occur, ascending."""
        for ids in self.ids(text):
            self._seen[ids] = True
        found = np.flatnonzero(self._seen).astype(np.int32)
        self._seen[found] = False
        return found

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that occur, ascending, and how often."""
        total = np.zeros(1 << self.bits, np.int64)
        for ids in self.ids(text):
            total += np.bincount(ids, minlength=1 << self.bits)
        found = np.flatnonzero(total)
        return found.astype(np.int32), total[found]
