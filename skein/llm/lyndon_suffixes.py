"""Suffix arrays by grouping suffixes by their Lyndon prefixes, in linear steps and without recursive renaming.

First phase: suffixes start in groups by first symbol. Groups are taken in descending order; every suffix of the group points
to the nearest position before it whose group is lower (previous smaller), found by following the pointers of higher ones. The
suffixes pointed to are moved, out of each of their groups, into new groups right behind: those with more pointers from the
group at hand end up higher. In the end a group holds the suffixes with the same Lyndon prefix, in order of those.

Second phase: the groups' orders come out in one ascending pass. The suffix before a placed one, and those on its chain of
pointers, are each the least that is left of their group.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order; a suffix comes before the longer ones that begin with it."""
    n = len(text) + 1  # with an end below all symbols
    if n == 1:
        return []
    counts = [0] * (max(text) + 2)
    for c in text:
        counts[c + 1] += 1
    group_at: list[int] = []  # first place of each symbol's group
    total = 1
    for c in counts[1:]:
        group_at.append(total)
        total += c
    # members: suffixes by group; place: of each suffix in members; low: first place of its group; size by first place.
    fill = group_at[:]
    members, place, low = [n - 1] * n, [0] * n, [0] * n
    for i, c in enumerate(text):
        p = fill[c]
        fill[c] = p + 1
        members[p] = i
        place[i] = p
        low[i] = group_at[c]
    size = [0] * n
    size[0] = 1
    for c, k in enumerate(counts[1:]):
        if k:
            size[group_at[c]] = k
    previous = [-1] * n
    high = n
    while high > 1:
        start = low[members[high - 1]]
        group = members[start:high]
        high = start
        if len(group) > 1:
            group.sort()
        pointed: dict[int, int] = {}
        for i in group:
            j = i - 1
            while j >= 0 and low[j] >= start:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if not pointed:
            continue
        if len(pointed) == 1:
            levels = [list(pointed)]
        else:
            by_count: dict[int, list[int]] = {}
            for j, k in pointed.items():
                by_count.setdefault(k, []).append(j)
            levels = [by_count[k] for k in sorted(by_count, reverse=True)]
        for level in levels:
            moved: dict[int, int] = {}
            for j in level:  # to the end of its old group
                g = low[j]
                m = moved.get(g, 0) + 1
                moved[g] = m
                to = g + size[g] - m
                p = place[j]
                if p != to:
                    other = members[to]
                    members[p] = other
                    place[other] = p
                    members[to] = j
                    place[j] = to
            for g, m in moved.items():
                left = size[g] - m
                if left:
                    size[g] = left
                    size[g + left] = m
            for j in level:
                g = low[j]
                if place[j] >= g + size[g]:  # not where the whole group moved: it stays what it is
                    low[j] = g + size[g]
    out = [-1] * n
    out[0] = n - 1
    done = bytearray(n)
    done[n - 1] = 1
    filled: dict[int, int] = {}  # next place by first place of a group
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = low[j]
            at = filled.get(g, g)
            filled[g] = at + 1
            out[at] = j
            done[j] = 1
            j = previous[j]
    return out[1:]
