"""Suffix arrays by linear grouping, of many texts at once.

Suffixes are grouped by their first symbol. From the greatest group to the least, a group's members point to the nearest
position before them that lies in a smaller group. These positions move out of their group into groups right after it,
one for each number of members that point to them: what they are grouped by grows by that many copies of the member's
own prefix, so that in the end suffixes share a group if they share their longest Lyndon prefix. The second phase goes
through the order from its least suffix on: the position before a sorted suffix, and the chain of pointers from there,
are the next of their groups. No ranks are ever renamed.

Every position is grouped, moved and placed in arrays of slots, a group being a range of them. Texts are independent of
each other, so each step takes the next group (in the second phase the next suffix) of all of them in one go.
"""

from __future__ import annotations

import numpy as np


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at `starts`."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class _Groups:
    """Slots, their members, and each position's group, which is named by its first slot."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        key = text * (int(symbols.max(initial=0)) + 1) + symbols
        self.members = np.argsort(key, kind="stable")
        self.slot = np.empty_like(self.members)
        self.slot[self.members] = np.arange(len(key))
        ordered = key[self.members]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(key)))
        self.group = np.empty_like(self.members)
        self.group[self.members] = np.repeat(first, sizes)
        self.size = np.zeros(len(key), np.int64)
        self.size[first] = sizes
        self.moving = np.zeros(len(key), bool)

    def split(self, at: np.ndarray, times: np.ndarray) -> None:
        """Moves positions to the end of their groups' slots, by how many times they are pointed to, as groups of their own."""
        order = np.lexsort((times, self.group[at]))
        at, times = at[order], times[order]
        old = self.group[at]
        first = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        n = np.diff(np.append(first, len(at)))
        start = np.repeat(old[first] + self.size[old[first]] - n, n)
        target = start + np.arange(len(at)) - np.repeat(first, n)
        self.moving[at] = True
        there, here = self.members[target], self.slot[at]
        pushed, hole = there[~self.moving[there]], here[here < start]  # as many of either in each group, in the groups' order
        self.members[hole], self.slot[pushed] = pushed, hole
        self.members[target], self.slot[at] = at, target
        self.moving[at] = False
        self.size[old[first]] -= n
        new = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])))
        sizes = np.diff(np.append(new, len(at)))
        self.size[target[new]] = sizes
        self.group[at] = np.repeat(target[new], sizes)


def _pointers(g: _Groups, bounds: np.ndarray) -> np.ndarray:
    """The first phase: splits all groups, returns each position's previous smaller position (-1: none)."""
    previous = np.full(len(g.members), -1, np.int64)
    begin, end = bounds[:-1], bounds[1:].copy()
    live = np.flatnonzero(end > begin)
    while len(live):
        top = g.group[g.members[end[live] - 1]]
        sizes = end[live] - top
        at = g.members[_spread(top, sizes)]
        own, least = np.repeat(top, sizes), np.repeat(begin[live], sizes)
        j = at - 1
        left = np.flatnonzero((j >= least) & (g.group[j] >= own))
        while len(left):  # a greater group's pointers are known; those of the same group are being found
            k = j[left]
            j[left] = np.where(g.group[k] > own[left], previous[k], k - 1)
            left = left[(j[left] >= least[left]) & (g.group[j[left]] >= own[left])]
        found = j >= least
        previous[at] = np.where(found, j, -1)
        if found.any():
            g.split(*np.unique(j[found], return_counts=True))
        end[live] = top
        live = live[top > begin[live]]
    return previous


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array of each of many texts (ranges of one array), as absolute positions; every text ends with its only
    least symbol. Symbols are small whole numbers from 0."""
    g = _Groups(symbols, bounds)
    previous = _pointers(g, bounds)
    out, placed = np.full(len(symbols), -1, np.int64), np.zeros(len(symbols), bool)
    free = np.arange(len(symbols))  # of each group, the first slot that is not taken yet
    full = np.flatnonzero(np.diff(bounds) > 0)
    begin, length = bounds[full], np.diff(bounds)[full]
    out[begin], placed[bounds[full + 1] - 1] = bounds[full + 1] - 1, True
    by_size = np.argsort(-length, kind="stable")
    begin, length = begin[by_size], length[by_size]
    for step in range(int(length.max(initial=0))):
        least = begin[: int(np.searchsorted(-length, -step))]
        j = out[least + step] - 1
        ok = j >= least
        j, least = j[ok], least[ok]
        ok = ~placed[j]
        j, least = j[ok], least[ok]
        while len(j):
            group = g.group[j]
            out[free[group]] = j
            free[group] += 1
            placed[j] = True
            j = previous[j]
            ok = j >= least
            j, least = j[ok], least[ok]
            ok = ~placed[j]
            j, least = j[ok], least[ok]
    return out
