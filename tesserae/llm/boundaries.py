"""A compressed set of token boundaries with rank and select.

Positions are divided by their upper bits into chunks of 2^16.  A chunk's lower bits are
kept in whichever container is smallest: a sorted array, a bit map, or runs of
neighbours.  Next to the containers stand the cumulative cardinalities, so the k-th
boundary is found by a search among these and a select inside one container.
"""

from __future__ import annotations

import numpy as np

CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


class ArrayContainer:
    """Lower bits as a sorted array: two bytes a member."""

    kind = "array"

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    @staticmethod
    def cost(low: np.ndarray) -> int:
        return 2 * len(low)

    def select(self, k: int) -> int:
        return int(self.low[k])

    def rank(self, x: int) -> int:
        return int(np.searchsorted(self.low, x, "right"))


class BitmapContainer:
    """A bit for each of the 2^16 places, with the number of bits before each 8-byte word."""

    kind = "bitmap"

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CHUNK, np.uint8)
        bits[low] = 1
        self.bytes = np.packbits(bits, bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(_ONES[self.bytes].reshape(-1, 8).sum(axis=1))])

    @staticmethod
    def cost(low: np.ndarray) -> int:
        return CHUNK // 8

    def _word(self, w: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.bytes[8 * w : 8 * w + 8], bitorder="little"))

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, "right")) - 1
        return 64 * w + int(self._word(w)[k - int(self.before[w])])

    def rank(self, x: int) -> int:
        w = x >> 6
        return int(self.before[w]) + int(np.count_nonzero(self._word(w) <= (x & 63)))


class RunContainer:
    """First members and lengths of runs, with the number of members before each run."""

    kind = "run"

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.concatenate([[True], np.diff(low) > 1]))
        self.start = low[first].astype(np.int64)
        self.before = np.concatenate([first, [len(low)]])

    @staticmethod
    def cost(low: np.ndarray) -> int:
        return 2 + 4 * (1 + int(np.count_nonzero(np.diff(low) > 1)))

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.start[r]) + k - int(self.before[r])

    def rank(self, x: int) -> int:
        r = int(np.searchsorted(self.start, x, "right")) - 1
        return 0 if r < 0 else min(int(self.before[r + 1]), int(self.before[r]) + x - int(self.start[r]) + 1)


_KINDS = (ArrayContainer, RunContainer, BitmapContainer)


class BoundarySet:
    """Sorted distinct positions, not negative."""

    def __init__(self, positions: np.ndarray):
        positions = np.asarray(positions, np.int64)
        upper = positions >> CHUNK_BITS
        first = np.flatnonzero(np.concatenate([[len(positions) > 0], np.diff(upper) > 0])) if len(positions) else np.empty(0, np.int64)
        self.keys = upper[first]
        self.before = np.concatenate([first, [len(positions)]])
        parts = [positions[a:b] & (CHUNK - 1) for a, b in zip(self.before[:-1], self.before[1:], strict=True)]
        self.containers = [min(_KINDS, key=lambda kind, low=low: kind.cost(low))(low) for low in parts]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th position, counted from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[c]) << CHUNK_BITS) + self.containers[c].select(k - int(self.before[c]))

    def rank(self, position: int) -> int:
        """How many members are not beyond ``position``."""
        c = int(np.searchsorted(self.keys, position >> CHUNK_BITS, "right")) - 1
        if c < 0:
            return 0
        if int(self.keys[c]) < position >> CHUNK_BITS:
            return int(self.before[c + 1])
        return int(self.before[c]) + self.containers[c].rank(position & (CHUNK - 1))
