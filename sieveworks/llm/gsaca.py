"""Suffix arrays by linear grouping.

Suffixes are first grouped by their Lyndon prefix (the longest prefix of the
suffix that is a Lyndon word), then each group is put in order; no renaming
and no recursion.

Phase one starts from the groups of equal first symbols and takes the groups
from the largest down.  For each suffix of the group at hand, the previous
smaller pointer leads to the nearest earlier suffix in a smaller group; that
suffix's Lyndon prefix is known to be followed by the one of this group as
often as pointers of the group lead to it.  Suffixes of one smaller group that
are followed equally often leave it together and form a new group just behind
it, those followed more often further behind.

Phase two goes through the array from the smallest suffix: the suffix before
the one at hand, and from there along the previous smaller pointers while
suffixes are not yet placed, each takes the next place of its group.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> list[int]:
    """Start positions of the suffixes in ascending order.  Symbols are whole
    numbers in any range; the empty suffix is not listed."""
    n = len(text)
    if n == 0:
        return []
    # a sentinel below every symbol ends the text
    _, symbol = np.unique(text, return_inverse=True)
    symbol = np.append(symbol.reshape(-1) + 1, 0)
    order = np.argsort(symbol, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(symbol[order]) > 0])
    sizes = np.diff(np.r_[starts, n + 1])
    group = np.empty(n + 1, dtype=np.int64)
    group[order] = np.repeat(starts, sizes)
    size = dict(zip(starts.tolist(), sizes.tolist(), strict=True))
    order, group = order.tolist(), group.tolist()
    place = [0] * (n + 1)
    for i, s in enumerate(order):
        place[s] = i

    previous = [-1] * (n + 1)   # nearest earlier suffix of a smaller group
    jump = [-1] * (n + 1)       # the same with paths shortened
    end = n + 1
    while end > 0:
        at = group[order[end - 1]]
        members = order[at:end]
        members.sort()
        followed: dict[int, int] = {}
        for s in members:
            j, passed = s - 1, []
            while j >= 0 and group[j] >= at:
                passed.append(j)
                j = jump[j]
            for x in passed:
                jump[x] = j
            previous[s] = jump[s] = j
            if j >= 0:
                followed[j] = followed.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for s, times in followed.items():
            moves.setdefault((-times, group[s]), []).append(s)
        for (_, old), leaving in sorted(moves.items()):
            left = size[old] - len(leaving)
            if left == 0:
                continue   # the whole group goes on as it is
            # the leavers take the last places of their group
            tail = old + left
            gone = set(leaving)
            holes = [place[s] for s in leaving if place[s] < tail]
            stay = [order[i] for i in range(tail, tail + len(leaving)) if order[i] not in gone]
            for hole, s in zip(holes, stay, strict=True):
                order[hole] = s
                place[s] = hole
            for i, s in enumerate(leaving):
                order[tail + i] = s
                place[s] = tail + i
                group[s] = tail
            size[old], size[tail] = left, len(leaving)
        end = at

    out = [-1] * (n + 1)
    out[0] = n
    free = {g: g for g in size}
    done = [False] * (n + 1)
    done[n] = True
    for i in range(n + 1):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = previous[s]
    return out[1:]


def common_prefixes(text: list[int], array: list[int], stop: int) -> list[int]:
    """Per rank, the symbols that a suffix shares with the one before it in the
    array; symbols below ``stop`` end a match."""
    n = len(text)
    rank = [0] * n
    for i, s in enumerate(array):
        rank[s] = i
    out, h = [0] * n, 0
    for s in range(n):
        r = rank[s]
        if r == 0:
            h = 0
            continue
        t = array[r - 1]
        while s + h < n and t + h < n and text[s + h] == text[t + h] and text[s + h] >= stop:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out
