"""Suffix arrays by linear grouping construction.

Phase 1 groups suffixes by their Lyndon prefix. Groups start as first symbols and are taken in
descending order. Each member of the group points to its previous smaller suffix, the nearest
position to the left in a lower group; found by jumping over pointers known already. The
suffixes pointed at are extended by the group's prefix: those hit more often rank higher, and
each set of equal hits leaves its group for a new one just above it.

Phase 2 walks the array from its start: each suffix placed hands its left neighbour, and along
the pointers that one's ancestors, the first free place of their groups. Nothing is renamed and
nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence


def group_suffixes(s: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(members in group order, each suffix's group start, each suffix's previous smaller suffix or -1)."""
    n = len(s)
    sizes = [0] * (max(s) + 2)
    for c in s:
        sizes[c + 1] += 1
    for c in range(1, len(sizes)):
        sizes[c] += sizes[c - 1]
    group = [sizes[c] for c in s]
    size = [0] * (n + 1)
    member, place = [0] * n, [0] * n
    for i, g in enumerate(group):
        k = g + size[g]
        member[k], place[i] = i, k
        size[g] += 1
    prev = [-1] * n
    end = n
    while end:
        start = group[member[end - 1]]
        hits: dict[int, int] = {}
        own = member[start:end]
        if end - start > 1:
            own.sort()  # then a neighbour in the same group is done before it is asked
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if hits:
            most = max(hits.values())
            if most == 1:
                _raise(list(hits), group, size, member, place)
            else:
                by: dict[int, list[int]] = {}
                for j, k in hits.items():
                    by.setdefault(k, []).append(j)
                for k in sorted(by, reverse=True):
                    _raise(by[k], group, size, member, place)
        end = start
    return member, group, prev


def _raise(those: list[int], group: list[int], size: list[int], member: list[int], place: list[int]) -> None:
    """Each group's suffixes among those become a group of their own just above the rest of it."""
    if len(those) == 1:
        j = those[0]
        g = group[j]
        if size[g] == 1:
            return
        size[g] -= 1
        k = g + size[g]
        o, p = member[k], place[j]
        member[p], place[o], member[k], place[j] = o, p, j, k
        group[j], size[k] = k, 1
        return
    for j in those:
        g = group[j]
        size[g] -= 1
        k, p = g + size[g], place[j]
        o = member[k]
        member[p], place[o], member[k], place[j] = o, p, j, k
    moved = [(j, group[j] + size[group[j]]) for j in those]
    for j, k in moved:
        if group[j] != k:
            group[j] = k
            size[k] = 0
    for _, k in moved:
        size[k] += 1


def suffix_array(text: bytes | Sequence[int]) -> list[int]:
    """Starts of the suffixes in lexicographic order (a shorter one before those it begins)."""
    n = len(text)
    if not n:
        return []
    s = [c + 1 for c in text]
    s.append(0)
    _, group, prev = group_suffixes(s)
    starts: dict[int, int] = {}  # a group's next free place, once it has given one away
    out = [-1] * (n + 1)
    out[0] = n
    for i in range(n + 1):
        j = out[i] - 1
        while j >= 0 and (g := group[j]) >= 0:
            k = starts.get(g, g)
            out[k] = j
            starts[g] = k + 1
            group[j] = -1  # placed
            j = prev[j]
    return out[1:]
