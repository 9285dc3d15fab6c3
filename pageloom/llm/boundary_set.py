"""A compressed set of increasing positions with rank and select, in the manner of Roaring.

Positions are grouped by their upper bits into containers of 65,536 values. A container is
kept in the smallest of three forms: an array of its lower 16 bits, a bitmap, or runs
(begin and length). Cumulative cardinalities lead a rank to its container; what is left of
the rank selects inside it.
"""

from __future__ import annotations

import numpy as np

SPAN = 1 << 16
ARRAY, BITMAP, RUNS = "array", "bitmap", "runs"
_BYTE_COUNTS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)


class Container:
    """Lower bits of the positions of one span."""

    __slots__ = ("form", "data", "size")

    def __init__(self, lows: np.ndarray):
        """``lows``: increasing numbers below ``SPAN``."""
        self.size = len(lows)
        breaks = np.flatnonzero(np.diff(lows) != 1) + 1
        costs = {ARRAY: 2 * self.size, BITMAP: SPAN // 8, RUNS: 4 * (len(breaks) + 1)}
        self.form = min(costs, key=costs.get)
        if self.form == RUNS:
            firsts = np.concatenate([[0], breaks])
            lengths = np.diff(firsts, append=self.size)
            self.data = (lows[firsts].astype(np.uint16), np.cumsum(lengths) - lengths)
        elif self.form == ARRAY:
            self.data = lows.astype(np.uint16)
        else:
            bits = np.zeros(SPAN, np.uint8)
            bits[lows] = 1
            packed = np.packbits(bits)
            before = np.concatenate([[0], np.cumsum(_BYTE_COUNTS[packed])])
            self.data = (packed, before)

    def select(self, rank: int) -> int:
        """The member with ``rank`` smaller ones."""
        if self.form == ARRAY:
            return int(self.data[rank])
        if self.form == RUNS:
            begins, before = self.data
            run = int(np.searchsorted(before, rank, "right")) - 1
            return int(begins[run]) + rank - int(before[run])
        packed, before = self.data
        byte = int(np.searchsorted(before, rank, "right")) - 1
        members = np.flatnonzero(np.unpackbits(packed[byte : byte + 1]))
        return 8 * byte + int(members[rank - int(before[byte])])


class BoundarySet:
    """Increasing positions from zero on."""

    def __init__(self, positions: np.ndarray):
        keys = positions >> 16
        cuts = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys = keys[cuts]
        self.before = np.append(cuts, len(positions))  # members in earlier containers
        self.containers = [
            Container(positions[a:b] & (SPAN - 1)) for a, b in zip(self.before[:-1], self.before[1:])
        ]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, rank: int) -> int:
        """The member with ``rank`` smaller ones."""
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        at = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.keys[at]) * SPAN + self.containers[at].select(rank - int(self.before[at]))
