"""Sparse incidence matrices by compressed rows, and how two cuts of one byte string align."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from pageloom.llm.packing import slices

WINDOW = 1 << 18  # bytes; longer strings are aligned part by part


class Csr(NamedTuple):
    """Row i has ``indices[indptr[i]:indptr[i + 1]]`` as columns and ``data`` there."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.searchsorted(self.indices[order], np.arange(self.columns + 1))
        return Csr(indptr, self.rows[order], self.data[order], len(self.indptr) - 1)

    def reached(self, other: Csr) -> np.ndarray:
        """Entries that each entry of this matrix adds to the product with ``other``."""
        return np.diff(other.indptr)[self.indices]

    def times(self, other: Csr) -> Csr:
        """Row products: each row is the sum of the rows of ``other`` at its columns."""
        sizes = self.reached(other)
        at = slices(other.indptr[self.indices], sizes)
        row, column = np.repeat(self.rows, sizes), other.indices[at]
        value = np.repeat(self.data, sizes) * other.data[at]
        key = row * other.columns + column
        if np.any(np.diff(key) < 0):
            order = np.argsort(key, kind="stable")
            key, row, column, value = key[order], row[order], column[order], value[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        value = np.add.reduceat(value, first) if len(first) else value
        indptr = np.searchsorted(row[first], np.arange(len(self.indptr)))
        return Csr(indptr, column[first], value, other.columns)


def token_bytes(ends: np.ndarray) -> Csr:
    """Tokens by the bytes they cover, where they cover all up to each end."""
    size = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]), np.arange(size), np.ones(size, np.int64), size)


def token_groups(groups: np.ndarray, n: int) -> Csr:
    """Tokens by the group they lie in."""
    return Csr(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int64), n)


class Alignment(NamedTuple):
    link_a: np.ndarray  # tokens of both cuts whose bytes end together
    link_b: np.ndarray
    group_a: np.ndarray  # group of each token, from 0
    group_b: np.ndarray
    overlaps: int  # pairs of tokens that share a byte
    group_sizes: np.ndarray  # pairs of tokens of each group


def _windows(common: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of groups of about ``WINDOW`` bytes."""
    begin = 0
    while begin < len(common):
        base = int(common[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(common, base + WINDOW, "right")))
        yield begin, end
        begin = end


def align(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Alignment:
    """Aligns two cuts of one byte string, given the bytes of their tokens (at least one
    each). Groups are cut where tokens of both end."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    link_a, link_b, overlaps, sizes = [], [], 0, []
    for begin, end in _windows(common):
        base = int(common[begin - 1]) if begin else 0
        (a0, a1), (b0, b1) = (np.searchsorted(g, (begin, end)) for g in (group_a, group_b))
        own_a, own_b = ends_a[a0:a1] - base, ends_b[b0:b1] - base
        overlap = token_bytes(own_a).times(token_bytes(own_b).transposed())
        overlaps += len(overlap.indices)
        row = overlap.rows
        together = own_a[row] == own_b[overlap.indices]
        link_a.append(a0 + row[together])
        link_b.append(b0 + overlap.indices[together])
        of_a = token_groups(group_a[a0:a1] - begin, end - begin)
        of_b = token_groups(group_b[b0:b1] - begin, end - begin).transposed()
        sizes.append(np.bincount(of_a.indices, of_a.reached(of_b), end - begin).astype(np.int64))
    none = np.zeros(0, np.int64)
    return Alignment(
        np.concatenate([none, *link_a]),
        np.concatenate([none, *link_b]),
        group_a,
        group_b,
        overlaps,
        np.concatenate([none, *sizes]),
    )


def shared_group_links(found: Alignment) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All token pairs of each group, window by window: the product of the group
    incidences. A group of m and n tokens has m * n of them."""
    n = len(found.group_sizes)
    total = np.cumsum(found.group_sizes)
    begin = 0
    while begin < n:
        base = int(total[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + WINDOW, "right")))
        (a0, a1), (b0, b1) = (np.searchsorted(g, (begin, end)) for g in (found.group_a, found.group_b))
        of_a = token_groups(found.group_a[a0:a1] - begin, end - begin)
        of_b = token_groups(found.group_b[b0:b1] - begin, end - begin)
        links = of_a.times(of_b.transposed())
        yield a0 + links.rows, b0 + links.indices
        begin = end
