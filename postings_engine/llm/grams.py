"""Sets of hashed character n-grams of whole texts."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20


class GramSets:
    """Finds the distinct n-grams of a text as slots below 2^bits; one scratch table is used again and again."""

    def __init__(self, sizes: tuple[int, ...], bits: int):
        self.sizes, self.bits = sizes, bits
        self.seen = np.zeros(1 << bits, bool)

    def of(self, text: str) -> np.ndarray:
        """Sorted slots of the n-grams of the lower-cased text, blanks run together and added at both ends."""
        codes = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
        most = max(self.sizes)
        for start in range(0, len(codes), _BLOCK):  # blocks overlap by an n-gram
            part = codes[start:start + _BLOCK + most - 1]
            for size in self.sizes:
                if len(part) < size:
                    continue
                h = np.full(len(part) - size + 1, size, np.uint64)
                for k in range(size):
                    h = (h ^ part[k:len(part) - size + 1 + k]) * _STEP
                    h ^= h >> np.uint64(29)
                self.seen[h & np.uint64((1 << self.bits) - 1)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.int32)
