"""A cuckoo filter that can be stored in a row: 16-bit fingerprints, four to a bucket, and deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_KICKS = 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Holds 64-bit hashes, each once. Look-ups never miss a member; about one stranger in 8000 passes."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * 0.85 < max(n, 1):
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _spread(np.asarray(hashes, np.int64).view(np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        mask = np.uint64(len(self.table) - 1)
        first = (h & mask).astype(np.int64)
        return prints, first, first ^ self._jump(prints)

    def _jump(self, prints: np.ndarray) -> np.ndarray:
        return (_spread(prints) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(hashes)
        return (self.table[a] == prints[:, None]).any(axis=1) | (self.table[b] == prints[:, None]).any(axis=1)

    def add(self, hashes: np.ndarray) -> bool:
        """False if it became too full; the caller then makes a larger one from the exact table."""
        prints, a, b = self._places(hashes)
        rng = np.random.default_rng(len(self.table))
        for p, places in zip(prints, zip(a, b, strict=True), strict=True):
            for at in places:
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = p
                    break
            else:
                at = places[1]
                for _ in range(_KICKS):
                    slot = int(rng.integers(SLOTS))
                    p, self.table[at, slot] = self.table[at, slot], p
                    at ^= int(self._jump(np.array([p], np.uint16))[0])
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = p
                        break
                else:
                    return False
        return True

    def remove(self, hashes: np.ndarray) -> None:
        """Only hashes that were added may be removed."""
        prints, a, b = self._places(hashes)
        for p, places in zip(prints, zip(a, b, strict=True), strict=True):
            for at in places:
                found = np.flatnonzero(self.table[at] == p)
                if len(found):
                    self.table[at, found[0]] = 0
                    break


def built(hashes: np.ndarray) -> CuckooFilter:
    """A filter with these hashes, as large as it has to be."""
    n = len(hashes)
    while True:
        made = CuckooFilter.sized(n)
        if made.add(hashes):
            return made
        n = max(2 * n, 8)
