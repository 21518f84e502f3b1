"""Suffix arrays by linear grouping: groups of suffixes with one Lyndon prefix, then the order inside each group."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Start of each suffix in order. The text must end with a value smaller than all others, which occurs there alone.

    Groups begin as suffixes with one first value and are worked through from the greatest to the smallest. A suffix of
    the current group points back to the nearest earlier suffix in a smaller group: its previous smaller suffix, whose Lyndon
    prefix therefore goes on with that of the current group. Suffixes that were pointed at leave their group for new ones
    just behind it, by how often they were pointed at. When all groups are done, each holds the suffixes with one Lyndon
    prefix, in order. Then suffixes are put in place in ascending order: each placed suffix gives the next place in their
    groups to the suffix before it and to the previous smaller ones from there on, until one is placed already.
    """
    n = len(text)
    values = sorted(set(text))
    number = {v: i for i, v in enumerate(values)}
    members: list[list[int]] = [[] for _ in values]
    group = [0] * n
    for i, v in enumerate(text):
        g = number[v]
        group[i] = g
        members[g].append(i)
    size = [len(m) for m in members]  # members still in the group
    after = [*range(1, len(values)), -1]
    before = [-1, *range(len(values) - 1)]
    previous = [-1] * n
    done = bytearray(n)

    def open_group(g: int, part: list[int]) -> None:
        """A new group just behind ``g`` for members that leave it."""
        new, nxt = len(members), after[g]
        members.append(part)
        size.append(len(part))
        size[g] -= len(part)
        for p in part:
            group[p] = new
        after.append(nxt)
        before.append(g)
        after[g] = new
        if nxt >= 0:
            before[nxt] = new

    current = len(values) - 1
    while current >= 0:
        here = members[current]
        if size[current] == 1 == len(here):  # most groups, in the end
            i = here[0]
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            done[i] = 1
            if p >= 0 and size[g := group[p]] > 1:  # alone in its group, it would only get the same place again
                open_group(g, [p])
        elif size[current]:
            pointed: dict[int, int] = {}
            for i in here:
                if group[i] != current:
                    continue  # it has moved on to another group
                p = i - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                previous[i] = p
                done[i] = 1
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for p in sorted(pointed):
                if size[group[p]] > 1:
                    moved.setdefault((-pointed[p], group[p]), []).append(p)
            for times, g in sorted(moved):
                if size[g] > len(moved[times, g]):  # all that is left of a group may stay where it is
                    open_group(g, moved[times, g])
        current = before[current]

    # First place of each group.
    place = [0] * len(members)
    at, g = 0, 0
    while g >= 0:
        place[g] = at
        at += size[g]
        g = after[g]
    order = [-1] * n
    put = bytearray(n)
    order[0], put[n - 1] = n - 1, 1
    for k in range(n):
        s = order[k] - 1
        while s >= 0 and not put[s]:
            g = group[s]
            order[place[g]] = s
            place[g] += 1
            put[s] = 1
            s = previous[s]
    return order
