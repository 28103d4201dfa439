"""Best-fit decreasing over runs of equal sizes.

Sizes are integers, so items of one size are interchangeable and the open bins of one remaining capacity are too. The
functions below place a whole run at a time: the cost follows the number of different sizes and capacities, not the number of
items, and the outcome is the one of item-by-item best fit.

While a bin takes items of size s, it stays the tightest bin that holds s until less than s remains in it (its remaining
capacity falls below every other that fits). So m bins of remaining capacity r take r // s items each, one bin after another.
"""

from __future__ import annotations

from bisect import insort
from typing import NamedTuple


class Run(NamedTuple):
    """Items rank..rank+count-1 of one size go to bins bin, bin+1, ..., per items to each; the first starts at offset."""

    size: int
    rank: int
    count: int
    bin: int
    per: int
    offset: int


class SegmentTree:
    """Which remaining capacities have open bins: leaf r counts them, a node holds whether its range has any."""

    def __init__(self, capacity: int):
        self.n = 1 << max(1, capacity.bit_length())
        self.any = bytearray(2 * self.n)
        self.at: dict[int, list[tuple[int, int]]] = {}

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity that is at least ``size``."""
        i = size + self.n
        if self.any[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i + (not self.any[2 * i])
                return i - self.n
            i //= 2
        return None

    def _set(self, r: int, on: int) -> None:
        i = r + self.n
        self.any[i] = on
        while i > 1:
            i //= 2
            now = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def add(self, remaining: int, first: int, count: int) -> None:
        if count and remaining:
            if not self.at.get(remaining):
                self.at[remaining] = []
                self._set(remaining, 1)
            insort(self.at[remaining], (first, count))

    def take(self, remaining: int) -> tuple[int, int]:
        """The interval of bins with the lowest first bin of that remaining capacity, removed."""
        found = self.at[remaining].pop(0)
        if not self.at[remaining]:
            self._set(remaining, 0)
        return found


class BalancedTree:
    """The same over a balanced search tree (AVL) keyed by remaining capacity, for capacities too wide for an array."""

    class _Node:
        __slots__ = ("key", "bins", "left", "right", "height")

        def __init__(self, key, bins):
            self.key, self.bins, self.left, self.right, self.height = key, bins, None, None, 1

    def __init__(self, capacity: int):
        self.root = None

    @staticmethod
    def _h(node):
        return node.height if node else 0

    def _fix(self, n):
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        lean = self._h(n.left) - self._h(n.right)
        if lean > 1:
            if self._h(n.left.left) < self._h(n.left.right):
                n.left = self._rotate(n.left, "right", "left")
            return self._rotate(n, "left", "right")
        if lean < -1:
            if self._h(n.right.right) < self._h(n.right.left):
                n.right = self._rotate(n.right, "left", "right")
            return self._rotate(n, "right", "left")
        return n

    def _rotate(self, n, up, down):
        top = getattr(n, up)
        setattr(n, up, getattr(top, down))
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        setattr(top, down, n)
        top.height = 1 + max(self._h(top.left), self._h(top.right))
        return top

    def tightest(self, size: int) -> int | None:
        node, best = self.root, None
        while node:
            if node.key >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        return best

    def add(self, remaining: int, first: int, count: int) -> None:
        if count and remaining:
            self.root = self._insert(self.root, remaining, (first, count))

    def _insert(self, n, key, bins):
        if n is None:
            return self._Node(key, [bins])
        if key == n.key:
            insort(n.bins, bins)
            return n
        if key < n.key:
            n.left = self._insert(n.left, key, bins)
        else:
            n.right = self._insert(n.right, key, bins)
        return self._fix(n)

    def take(self, remaining: int) -> tuple[int, int]:
        node = self.root
        while node.key != remaining:
            node = node.left if remaining < node.key else node.right
        found = node.bins.pop(0)
        if not node.bins:
            self.root = self._delete(self.root, remaining)
        return found

    def _delete(self, n, key):
        if key < n.key:
            n.left = self._delete(n.left, key)
        elif key > n.key:
            n.right = self._delete(n.right, key)
        elif n.left is None or n.right is None:
            return n.left or n.right
        else:
            least = n.right
            while least.left:
                least = least.left
            n.key, n.bins = least.key, least.bins
            n.right = self._delete(n.right, least.key)
        return self._fix(n)


def best_fit_decreasing(counts: dict[int, int], capacity: int, tree: type = SegmentTree) -> tuple[list[Run], int]:
    """Pack ``counts[size]`` items of each size (1..capacity) into bins of ``capacity``: (runs, number of bins).

    Larger sizes go first; each item enters the open bin of least remaining capacity that holds it, of equals the one with the
    lowest number; where none fits, a new bin opens."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError(f"sizes must lie in 1..{capacity}")
    open_, runs, bins = tree(capacity), [], 0
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[size]
        while left:
            r = open_.tightest(size)
            if r is None:
                r, per = capacity, capacity // size
                first, m = bins, -(-left // per)
                bins += m
            else:
                per = r // size
                first, m = open_.take(r)
            placed = min(left, m * per)
            runs.append(Run(size, rank, placed, first, per, capacity - r))
            full, part = divmod(placed, per)
            open_.add(r - per * size, first, full)
            if part:
                open_.add(r - part * size, first + full, 1)
            used = full + bool(part)
            open_.add(r, first + used, m - used)
            rank, left = rank + placed, left - placed
    return runs, bins


