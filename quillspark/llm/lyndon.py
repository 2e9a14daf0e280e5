"""Suffix sorting by linear grouping, for many independent texts in step.

First suffixes are grouped by their first symbol. Groups are taken in descending order. For each suffix of a group its
previous-smaller pointer leads to the last suffix before it in a lower group; what such pointers meet shares the lower
group's context followed by as many copies of this group's as pointers meet it, and moves to a new group just above its
old one. In the end a group holds the suffixes of one Lyndon prefix. Then the order within groups is emitted from the
least suffix on: when a suffix is placed, the one before it takes the next place of its group, and so on along the
pointers. No symbols are renamed and nothing recurs.

A step of Python handles one group, or places one suffix, of every text at once, so texts should be many and of like
length.
"""

from __future__ import annotations

import numpy as np

from .textbatch import ranges


#: Texts of one call have fewer than 2**31 symbols together.
PLACE = np.int32


def suffix_arrays(text: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of text[base[t]:base[t+1]], in order, for each t; each must end in its least symbol."""
    n, begin, stop = len(text), base[:-1], base[1:]
    owner = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(base))
    order = np.lexsort((text, owner)).astype(PLACE)
    place = np.empty(n, PLACE)
    place[order] = np.arange(n)
    new = np.r_[True, (text[order][1:] != text[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
    starts = np.flatnonzero(new)
    size = np.zeros(n, PLACE)
    size[starts] = np.diff(np.r_[starts, n])
    group = np.empty(n, PLACE)
    group[order] = np.repeat(starts, size[starts])
    before = _group(order, place, group, size, begin, stop.copy())
    return _emit(group, before, begin, stop)


def _group(order, place, group, size, begin, top) -> np.ndarray:
    """Refines order, place, group (each suffix's first place) and size; returns the previous-smaller pointers."""
    before = np.full(len(order), -1, PLACE)
    moved = np.zeros(len(order), bool)
    live = np.arange(len(begin))
    while len(live):
        low = group[order[top[live] - 1]]
        count = top[live] - low
        single = int(count.max()) == 1
        members = order[low] if single else order[ranges(low, count)]
        floor = begin[live] if single else np.repeat(begin[live], count)
        mine = low if single else np.repeat(low, count)
        p = members - 1
        todo = np.flatnonzero(p >= floor)
        while len(todo):
            q = p[todo]
            above = group[q] >= mine[todo]
            todo, q = todo[above], q[above]
            if not len(todo):
                break
            p[todo] = np.where(group[q] > mine[todo], before[q], q - 1)
            todo = todo[p[todo] >= floor[todo]]
        found = p >= floor
        before[members] = np.where(found, p, -1)
        if single:
            met, times = p[found], None
            old = group[met]
        else:
            met, times = np.unique(p[found], return_counts=True)
            old = group[met]
            by = np.lexsort((times, old))
            met, times, old = met[by], times[by], old[by]
        if len(met):
            first = np.ones(len(met), bool)
            if not single:
                first[1:] = old[1:] != old[:-1]
            heads = np.flatnonzero(first)
            many = np.diff(np.r_[heads, len(met)])
            tail = np.repeat(old[heads] + size[old[heads]] - many, many)
            to = tail + np.arange(len(met)) - np.repeat(heads, many)
            at = place[met]
            moved[met] = True
            there = order[to]
            out = there[~moved[there]]
            holes = at[at < tail]
            moved[met] = False
            order[holes], place[out] = out, holes
            order[to], place[met] = met, to
            if not single:
                first[1:] |= times[1:] != times[:-1]
            starts = np.flatnonzero(first)
            sizes = np.diff(np.r_[starts, len(met)])
            size[old[heads]] -= many
            size[to[starts]] = sizes
            group[met] = np.repeat(to[starts], sizes)
        top[live] = low
        live = live[low > begin[live]]
    return before


def _emit(group: np.ndarray, before: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    n = len(group)
    out = np.full(n, -1, PLACE)
    free = np.arange(n, dtype=PLACE)
    done = np.zeros(n, bool)
    out[begin] = stop - 1
    done[stop - 1] = True
    free[begin] += 1
    live, step = np.arange(len(begin)), 0
    while len(live):
        at = out[begin[live] + step] - 1
        floor = begin[live]
        ok = at >= floor
        at, floor = at[ok], floor[ok]
        while len(at):
            ok = ~done[at]
            at, floor = at[ok], floor[ok]
            if not len(at):
                break
            g = group[at]
            out[free[g]] = at
            free[g] += 1
            done[at] = True
            at = before[at]
            ok = at >= floor
            at, floor = at[ok], floor[ok]
        step += 1
        live = live[stop[live] - begin[live] > step]
    return out
