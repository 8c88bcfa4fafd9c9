"""Suffix sorting by Lyndon-prefix groups, over any integer alphabet.

Suffixes with the same longest Lyndon prefix form a group. Groups start as the suffixes of one symbol and are
taken in descending order; each suffix of the group taken finds, through previous-smaller pointers, the nearest
suffix before it in a group not yet taken. The Lyndon prefix of that one grows by the group's, so it moves to a
new group just above its own, those that grow by more copies above those that grow by fewer. In the second
phase the suffixes are read in ascending order; whatever suffix has its Lyndon prefix end where the one read
begins is next in its group. No names are assigned anew and nothing is sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start of each suffix in lexicographic order; a suffix comes before those it is a prefix of."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    edges = np.flatnonzero(np.diff(symbols[order], prepend=symbols[order[0]] - 1))
    # Group 0 is that of the end of the text, the least suffix.
    members: list[list[int]] = [[n], *(x.tolist() for x in np.split(order, edges[1:]))]
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    above[-1] = -1
    group = [0] * (n + 1)
    for g, part in enumerate(members):
        for i in part:
            group[i] = g
    taken = [False] * (n + 1)
    before = [-1] * (n + 1)

    g = len(members) - 1
    while g > 0:
        now = [i for i in members[g] if group[i] == g]
        members[g] = now
        now.sort()
        for i in now:
            taken[i] = True
        grown: dict[int, int] = {}
        for i in now:
            j = i - 1
            while j >= 0 and taken[j]:
                j = before[j]
            before[i] = j
            if j >= 0:
                grown[j] = grown.get(j, 0) + 1
        if grown:
            times = set(grown.values())
            for k in sorted(times, reverse=True):
                new: dict[int, int] = {}
                for p in grown if len(times) == 1 else [p for p, c in grown.items() if c == k]:
                    old = group[p]
                    if (to := new.get(old)) is None:
                        to = new[old] = len(members)
                        members.append([])
                        up = above[old]
                        above.append(up)
                        below.append(old)
                        above[old] = to
                        if up >= 0:
                            below[up] = to
                    group[p] = to
                    members[to].append(p)
        g = below[g]

    start, at, g = [0] * len(members), 0, 0
    while g >= 0:
        start[g] = at
        at += len(members[g])
        g = above[g]
    out, placed = [0] * (n + 1), [False] * (n + 1)
    out[0], placed[n] = n, True
    for r in range(n + 1):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            to = start[group[j]]
            start[group[j]] = to + 1
            out[to] = j
            placed[j] = True
            j = before[j]
    return np.array(out[1:], np.int64)
