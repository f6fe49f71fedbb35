"""Suffix sorting by linear grouping (two phases, without recursion or renaming).

Phase one keeps suffixes in groups by a prefix each. Groups are taken in descending order; for
each member i the pointer prev(i) goes to the nearest smaller position to its left in a lower
group, and the positions pointed to leave their groups for new ones just above them, those
pointed to by more members higher. At the end each group's prefix is the Lyndon prefix of its
suffixes. Phase two walks the order as it arises, from the end of the text on: each suffix found
emits those before it, along prev, to the front of their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of `text` (small non-negative integers) in ascending order."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    counts = np.bincount(text)
    begins = np.cumsum(counts) - counts
    sa, isa, group = order.tolist(), place.tolist(), begins[text].tolist()
    size = [0] * n
    for b, c in zip(begins[counts > 0].tolist(), counts[counts > 0].tolist(), strict=True):
        size[b] = c
    prev = [-1] * n
    group.append(-1)  # of position -1, before the text: lower than all
    end = n
    while end:
        start = group[sa[end - 1]]
        members = sa[start:end]
        members.sort()
        found = []
        for i in members:
            p = i - 1
            while group[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                found.append(p)
        end = start
        if len(set(found)) == len(found):
            levels = [found]
        else:
            pointed: dict[int, int] = {}
            for p in found:
                pointed[p] = pointed.get(p, 0) + 1
            by_count: dict[int, list[int]] = {}
            for p, c in pointed.items():
                by_count.setdefault(c, []).append(p)
            levels = [by_count[c] for c in sorted(by_count, reverse=True)]
        for level in levels:
            moved: dict[int, int] = {}
            for p in level:
                g = group[p]
                c = moved.get(g, 0) + 1
                moved[g] = c
                to = g + size[g] - c
                at = isa[p]
                if at != to:
                    other = sa[to]
                    sa[to], sa[at] = p, other
                    isa[p], isa[other] = to, at
            for g, c in moved.items():
                left = size[g] - c
                if left:
                    size[g] = left
                    new = g + left
                    size[new] = c
                    for p in sa[new : new + c]:
                        group[p] = new
    out = [-1] * n
    slot = list(range(n))
    free = bytearray(b"\x01") * n + b"\x00"  # nothing stands at -1
    for i in range(-1, n):
        s = out[i] - 1 if i >= 0 else n - 1
        while free[s]:
            free[s] = 0
            g = group[s]
            at = slot[g]
            out[at] = s
            slot[g] = at + 1
            s = prev[s]
    return np.array(out, dtype=np.int64)
