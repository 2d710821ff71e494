"""Linear-time suffix sorting by grouping, without recursion.

Phase 1 forms, in descending order of groups, the groups of suffixes that begin
with the same longest Lyndon prefix: the suffixes of a finished group push the
nearest smaller suffix before each of them (its *previous smaller* pointer) into a
higher group, those hit more often higher still. Phase 2 walks the sorted order from the
smallest suffix on and places, along the pointers, every suffix before the
current one at the next free place of its group.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``symbols`` (non-negative integers)."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.append(True, ranked[1:] != ranked[:-1])
    starts = np.flatnonzero(first)
    start_of = starts[np.cumsum(first) - 1]
    group_of = np.empty(n, dtype=np.int64)
    group_of[order] = start_of
    place_of = np.empty(n, dtype=np.int64)
    place_of[order] = np.arange(n)
    sizes = np.zeros(n, dtype=np.int64)
    sizes[starts] = np.diff(np.append(starts, n))
    # Lists: the loops below touch single elements, which lists do fastest.
    group, place, size, members = group_of.tolist(), place_of.tolist(), sizes.tolist(), order.tolist()
    smaller = [-1] * n

    last = n - 1
    while last >= 0:
        start = group[members[last]]
        if start == last:  # a group of one
            p = members[last] - 1
            while p >= 0 and group[p] > start:
                p = smaller[p]
            smaller[members[last]] = p
            if p >= 0 and size[group[p]] > 1:
                _raise_one(p, group, place, size, members)
        else:
            mine = sorted(members[start : last + 1])
            hit: dict[int, int] = {}
            for i in mine:
                p = i - 1
                while p >= 0:
                    g = group[p]
                    if g < start:
                        break
                    p = smaller[p]  # of the same group: smaller index, done before
                smaller[i] = p
                if p >= 0:
                    hit[p] = hit.get(p, 0) + 1
            if len(hit) == 1:
                p = next(iter(hit))
                if size[group[p]] > 1:
                    _raise_one(p, group, place, size, members)
            elif hit:
                by: dict[int, list[int]] = {}
                for p, times in hit.items():
                    key = times * n + group[p]  # hit more often first, then by group
                    if key in by:
                        by[key].append(p)
                    else:
                        by[key] = [p]
                for key in sorted(by, reverse=True):
                    some = by[key]
                    if size[key % n] > len(some):
                        if len(some) == 1:
                            _raise_one(some[0], group, place, size, members)
                        else:
                            _raise(some, group, place, size, members)
        last = start - 1

    out = [-1] * n
    free = list(range(n))  # next free place of the group that starts there
    smallest = n - 1
    # The last suffix may share its group with others; it is the smallest of the group.
    g = group[smallest]
    out[g] = smallest
    free[g] = g + 1
    done = bytearray(n)
    done[smallest] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = smaller[j]
    return np.array(out)


def _raise_one(j: int, group: list[int], place: list[int], size: list[int], members: list[int]) -> None:
    """Move one suffix to the end of its group, as a group of its own."""
    old = group[j]
    end = old + size[old] - 1
    at, other = place[j], members[end]
    members[at], members[end] = other, j
    place[other], place[j] = at, end
    size[old] -= 1
    size[end] = 1
    group[j] = end


def _raise(some: list[int], group: list[int], place: list[int], size: list[int], members: list[int]) -> None:
    """Move ``some`` of one group to its end, as a group of their own."""
    old = group[some[0]]
    end = old + size[old] - 1
    for j in some:
        at, other = place[j], members[end]
        members[at], members[end] = other, j
        place[other], place[j] = at, end
        end -= 1
    start = end + 1
    size[start] = len(some)
    size[old] -= len(some)
    for j in some:
        group[j] = start
