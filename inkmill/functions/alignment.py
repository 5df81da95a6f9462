"""Alignment of two sequences by their longest common blocks, as the review of texts asks for it.

Blocks and ties are those of the standard library's sequence matcher without junk: the longest common block first, of
equally long ones that which begins first on the left, then on the right; then the same on both sides of it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Hashable, Sequence
from heapq import heapify, heappop, heappush

import numpy as np


def _runs(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """Maximal diagonal runs of equal elements as (-length, left, right)."""
    places: dict[Hashable, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    met = [(i, places[x]) for i, x in enumerate(a) if x in places]
    if not met:
        return []
    i = np.repeat(np.array([m[0] for m in met]), [len(m[1]) for m in met])
    j = np.concatenate([m[1] for m in met])
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 1) | (np.diff(j - i) != 0))))
    sizes = np.diff(np.append(new, len(i)))
    return list(zip((-sizes).tolist(), i[new].tolist(), j[new].tolist(), strict=True))


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """Common blocks (left, right, length), in order.

    Runs wait in a heap, longest first. What is popped is cut to the gaps that the blocks so far leave; if that makes it
    shorter it waits again, else it is the longest of its gap and parts it. So no gap is searched anew for each block.
    """
    heap = _runs(a, b)
    heapify(heap)
    lefts, gaps = [0], [(0, len(a), 0, len(b))]
    found = []
    while heap:
        size, i, j = heappop(heap)
        end = i - size
        first = max(bisect_right(lefts, i) - 1, 0)
        pieces = []
        for at in range(first, len(gaps)):
            a1, a2, b1, b2 = gaps[at]
            if a1 >= end:
                break
            skip = max(a1 - i, b1 - j, 0)
            length = min(a2 - i, b2 - j, -size) - skip
            if length > 0:
                pieces.append((-length, i + skip, j + skip, at))
        if len(pieces) == 1 and pieces[0][0] == size:
            at = pieces[0][3]
            a1, a2, b1, b2 = gaps[at]
            found.append((i, j, -size))
            gaps[at : at + 1] = [(a1, i, b1, j), (end, a2, j - size, b2)]
            lefts[at : at + 1] = [a1, end]
        else:
            for piece in pieces:
                heappush(heap, piece[:3])
    return sorted(found)


def differing(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[str, int, int, int, int]]:
    """What differs between two sequences: (tag, left begin, left end, right begin, right end)."""
    found, i, j = [], 0, 0
    for x, y, size in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            found.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        i, j = x + size, y + size
    return found


class Automaton:
    """Suffix automaton of a text: the longest block that it shares with another one, in one pass over that."""

    def __init__(self, text: str) -> None:
        self._next: list[dict[str, int]] = [{}]
        self._link, self._size = [-1], [0]
        last = 0
        for c in text:
            own, p = len(self._next), last
            self._next.append({})
            self._size.append(self._size[last] + 1)
            self._link.append(0)
            while p >= 0 and c not in self._next[p]:
                self._next[p][c] = own
                p = self._link[p]
            if p >= 0:
                q = self._next[p][c]
                if self._size[q] == self._size[p] + 1:
                    self._link[own] = q
                else:
                    twin = len(self._next)
                    self._next.append(dict(self._next[q]))
                    self._size.append(self._size[p] + 1)
                    self._link.append(self._link[q])
                    while p >= 0 and self._next[p].get(c) == q:
                        self._next[p][c] = twin
                        p = self._link[p]
                    self._link[q] = self._link[own] = twin
            last = own

    def longest_in(self, text: str) -> tuple[int, int]:
        """Begin and length of the longest block of ``text`` that the automaton's text holds; the first of equal ones."""
        state = size = best = begin = 0
        for at, c in enumerate(text):
            while state and c not in self._next[state]:
                state = self._link[state]
                size = self._size[state]
            if c in self._next[state]:
                state, size = self._next[state][c], size + 1
            if size > best:
                best, begin = size, at + 1 - size
        return begin, best
