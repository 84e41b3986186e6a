"""Suffix array by linear grouping.

Suffixes are grouped by their longest known Lyndon prefix, first by one character. Groups
are processed from the highest to the lowest. Every suffix of a group points back to the
nearest earlier suffix of a lower group (its previous smaller suffix). That suffix's prefix
grows by the group's word, once for each suffix of the group that points to it, so it moves
up inside the range of its old group, and stays below all that was processed. When the last
group is done, groups are in their final order; one pass from the smallest suffix up, along
the same pointers, then emits the order inside every group. No ranks are renamed and no
reduced problem is solved.
"""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """Start positions of the suffixes of ``text`` in increasing order."""
    n = len(text) + 1
    symbols = [*text, -1]  # the end is smaller than any byte
    sizes = [0] * 258
    for c in symbols:
        sizes[c + 1] += 1
    starts, total = [0] * 258, 0
    for c in range(257):
        starts[c], total = total, total + sizes[c]
    group = [starts[c + 1] for c in symbols]  # start of the range of each suffix's group
    order, rank = [0] * n, [0] * n
    filled = starts[:]
    for i, c in enumerate(symbols):
        at = filled[c + 1]
        order[at], rank[i] = i, at
        filled[c + 1] = at + 1
    size = [0] * n  # of the group that starts here
    for c in range(257):
        if sizes[c]:
            size[starts[c]] = sizes[c]
    before = [-1] * n
    last = n
    while last > 0:
        first = group[order[last - 1]]
        times: dict[int, int] = {}
        members = order[first:last]
        members.sort()
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        last = first
        if not times:
            continue
        if len(times) == 1:
            (j,) = times
            g = group[j]
            if size[g] > 1:  # to the end of its range, as a group of its own
                size[g] -= 1
                at, end = rank[j], g + size[g]
                other = order[end]
                order[at], rank[other] = other, at
                order[end], rank[j] = j, end
                group[j], size[end] = end, 1
            continue
        # words with more copies of the group's word are larger: move them to the end first
        by_times: dict[int, list[int]] = {}
        for j, k in times.items():
            by_times.setdefault(k, []).append(j)
        for k in sorted(by_times, reverse=True):
            moving: dict[int, int] = {}
            for j in by_times[k]:
                g = group[j]
                count = moving.get(g, 0) + 1
                moving[g] = count
                at, end = rank[j], g + size[g] - count
                other = order[end]
                order[at], rank[other] = other, at
                order[end], rank[j] = j, end
            for j in by_times[k]:
                g = group[j]
                group[j] = g + size[g] - moving[g]
            for g, count in moving.items():
                size[g] -= count
                size[g + size[g]] = count
    return emit(group, before, n)


def emit(group: list[int], before: list[int], n: int) -> list[int]:
    """The suffixes in order, from groups in order and pointers to smaller suffixes."""
    out = [0] * n
    following = [0] * (n + 1)
    done = bytearray(n)
    j = n - 1
    out[0], done[j] = j, 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[g + following[g]] = j
            following[g] += 1
            done[j] = 1
            j = before[j]
    return out[1:]
