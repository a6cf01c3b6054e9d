"""Suffix sorting by linear grouping.

Phase 1 sorts suffixes into groups by their longest Lyndon prefix.  Groups
begin as the suffixes with one first symbol and are handled in descending
order.  For each suffix of a group the nearest suffix before it that lies in a
lower group is found along pointers; those suffixes have their prefix extended
by the group's, so they leave their own groups for new ones directly above,
the more often they were hit the higher.

Phase 2 goes through the result in ascending order: a suffix that is placed
places those whose Lyndon prefix ends where it begins at the front of their
groups.  Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes of `symbols`, positive integers; a suffix precedes those it begins."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    text = np.append(np.asarray(symbols, dtype=np.int64), 0)  # a unique smallest end
    order = np.argsort(text, kind="stable")
    held = text[order]
    first = np.concatenate([[True], held[1:] != held[:-1]])
    starts = np.flatnonzero(first)
    begin = starts[np.cumsum(first) - 1]
    sa = order.tolist()
    place = np.empty(n + 1, dtype=np.int64)
    place[order] = np.arange(n + 1)
    isa = place.tolist()
    of = np.empty(n + 1, dtype=np.int64)
    of[order] = begin
    group = of.tolist()  # start of a suffix's group in sa
    width = [0] * (n + 1)
    for a, w in zip(starts.tolist(), np.diff(np.append(starts, n + 1)).tolist()):
        width[a] = w
    lower = [-1] * (n + 1)
    hits = [0] * (n + 1)

    top = n + 1
    while top > 0:
        here = group[sa[top - 1]]
        if top - here == 1:
            # Most groups are one suffix: its pointer hits one suffix once.
            i = sa[here]
            p = i - 1
            while p >= 0 and group[p] >= here:
                p = lower[p]
            lower[i] = p
            top = here
            if p >= 0:
                old = group[p]
                w = width[old] - 1
                if w:
                    width[old] = w
                    last = old + w
                    q = sa[last]
                    at = isa[p]
                    sa[at], sa[last] = q, p
                    isa[q], isa[p] = at, last
                    group[p] = last
                    width[last] = 1
            continue
        members = sa[here:top]
        top = here
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > here:
                p = lower[p]
            lower[i] = p
        reached = []
        for i in members:
            p = lower[i]
            if p >= 0 and group[p] == here:
                chain = [i]
                while p >= 0 and group[p] == here:
                    chain.append(p)
                    p = lower[p]
                for c in chain:
                    lower[c] = p
            if p >= 0:
                if not hits[p]:
                    reached.append(p)
                hits[p] += 1
        if not reached:
            continue
        by_hits: dict[int, list[int]] = {}
        for p in reached:
            by_hits.setdefault(hits[p], []).append(p)
            hits[p] = 0
        for count in sorted(by_hits, reverse=True):
            moved = by_hits[count]
            touched = {}
            for p in moved:
                old = group[p]
                w = width[old] - 1
                width[old] = w
                last = old + w
                q = sa[last]
                at = isa[p]
                sa[at], sa[last] = q, p
                isa[q], isa[p] = at, last
                touched[old] = touched.get(old, 0) + 1
            for p in moved:
                old = group[p]
                group[p] = old + width[old]
            for old, m in touched.items():
                width[old + width[old]] = m

    done = [False] * (n + 1)
    out = [0] * (n + 1)
    out[0] = n
    done[n] = True
    for k in range(n + 1):
        p = out[k] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            # The group's front moves on with each suffix that is placed.
            front = hits[g]
            hits[g] = front + 1
            out[g + front] = p
            done[p] = True
            p = lower[p]
    return np.array(out[1:], dtype=np.int64)
