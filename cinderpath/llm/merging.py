"""Merging pairs by rank: of many short words at once, and of one long word."""

from __future__ import annotations

import heapq
from functools import cached_property

import numpy as np

NONE = 1 << 30
#: Words that are merged at once.
ROWS = 2048


class PairTable:
    """(left, right) -> (rank, made): the better rank is the smaller one."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], span: int):
        self.rank_of, self.span = pairs, span
        keys = np.array([a * span + b for a, b in pairs], np.int64)
        told = np.array([*pairs.values()], np.int64).reshape(-1, 2)
        order = keys.argsort()
        # a last key that no pair has, so that every search ends at a key
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.told = np.vstack([told[order], [[NONE, -1]]])

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The row of ``told`` of each pair; the last one for pairs that don't merge. Negative numbers are no symbols."""
        wanted = left.astype(np.int64) * self.span + right
        at = np.searchsorted(self.keys, wanted)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), at, len(self.keys) - 1)

    @cached_property
    def ranks(self) -> np.ndarray:
        return self.told[:, 0]

    def merge_rows(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges words whose symbols stand one after another: the symbols left, their places in ``symbols``, their number for each word.

        Each round merges the best pair (the leftmost of equal rank) of every word that has one. A row is a word between two empty
        columns; what a merge takes away becomes empty, and its neighbours are linked.
        """
        n, width = len(lengths), int(lengths.max(initial=0)) + 2
        column = np.arange(width)
        inside = (column >= 1) & (column <= lengths[:, None])
        ids = np.full((n, width), -1, np.int64)
        ids[inside] = symbols
        places = self.places(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        places = np.hstack([places, np.full((n, 1), len(self.keys) - 1)])
        ranks = self.ranks[places]
        after, before = np.tile(column + 1, (n, 1)), np.tile(column - 1, (n, 1))
        rows = np.arange(n)
        while len(rows):
            at = ranks[rows].argmin(axis=1)
            found = ranks[rows, at] < NONE
            rows, at = rows[found], at[found]
            gone = after[rows, at]
            right, left = after[rows, gone], before[rows, at]
            made = ids[rows, at] = self.told[places[rows, at], 1]
            ids[rows, gone], ranks[rows, gone] = -1, NONE
            after[rows, at], before[rows, right] = right, at
            for a, b, where in ((made, ids[rows, right], at), (ids[rows, left], made, left)):
                places[rows, where] = told = self.places(a, b)
                ranks[rows, where] = self.ranks[told]
        kept = ids >= 0
        numbers = np.zeros((n, width), np.int64)
        numbers[inside] = np.arange(len(symbols))
        return ids[kept], numbers[kept], kept.sum(axis=1)

    def merge_one(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The same for one word of any length, by a heap: the symbols left and their places."""
        n, get = len(symbols), self.rank_of.get
        ids, after, before = [*symbols], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if found := get((ids[a], ids[b])):
                heap.append((found[0], a, b, ids[a], ids[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(heap)
        while heap:
            _, a, b, left, right = heapq.heappop(heap)
            if ids[a] != left or ids[b] != right or after[a] != b:
                continue
            ids[a], ids[b], after[a] = get((left, right))[1], -1, after[b]
            if after[b] < n:
                before[after[b]] = a
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y < n and (found := get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, y, ids[x], ids[y]))
        kept = [i for i in range(n) if ids[i] >= 0]
        return [ids[i] for i in kept], kept
