"""Suffix arrays by linear grouping, for many short blocks of strings at once.

A block is a run of strings, each between separators (symbol 0), which are smaller than
every other symbol. Its suffixes are grouped by their Lyndon prefix, the longest prefix
that is a Lyndon word:

Phase 1 starts with groups by the first symbol and takes the groups in descending order.
For each suffix of a group the previous smaller pointer is followed (over suffixes of
higher groups, whose pointers are known) to its parent in a lower group. The parent's
prefix grows by one copy of the group's word for each of its children in the group, so
parents move to the end of their own group, those with more children behind.

Phase 2 takes the groups in ascending order and orders each by what follows the common
prefix: the next smaller suffix, which lies in a lower group and is in place already, or
in the same group, one copy of the word further on. No suffix is ever renamed and
nothing is sorted twice.

All blocks go through the same step together: a step takes the highest open group of
every block, so that numpy works on long arrays although each block is short.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of several ranges one after the other, and the range of each."""
    owner = np.repeat(np.arange(len(start)), size)
    first = np.cumsum(size) - size
    return np.arange(len(owner)) - (first - start)[owner], owner


def lyndon_groups(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: slots' suffixes, suffixes' slots, lengths of the Lyndon prefixes, ends of groups by first slot.

    ``bounds`` are the blocks' first positions and the end; each block begins and ends
    with a separator.
    """
    n = len(text)
    block = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = block * 512 + text
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(heads, n))
    group, slot, end = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n + 1, np.int64)
    group[sa] = np.repeat(heads, sizes)
    slot[sa] = np.arange(n)
    end[heads] = heads + sizes
    length, prev = np.ones(n, np.int64), np.arange(n) - 1
    moved, wanted = np.zeros(n, bool), np.zeros(n, bool)
    floor = bounds[:-1] + np.bincount(block[text == 0], minlength=len(bounds) - 1)
    top = bounds[1:].copy()
    open_ = np.flatnonzero(top > floor)
    while len(open_):
        last = top[open_]
        first = group[sa[last - 1]]
        at, owner = _ranges(first, last - first)
        member, own = sa[at], first[owner]
        parent = member - 1
        left = np.flatnonzero(group[parent] >= own)
        while len(left):
            parent[left] = prev[parent[left]]
            left = left[group[parent[left]] >= own[left]]
        prev[member] = parent
        real = text[parent] != 0
        if real.any():
            _grow(parent[real], length[member[real]], sa, slot, group, end, length, moved, wanted)
        top[open_] = first
        open_ = open_[first > floor[open_]]
    return sa, slot, length, end


def _grow(parent, word, sa, slot, group, end, length, moved, wanted) -> None:
    """Give parents their children's words and regroup them by the number of children."""
    parents, index, copies = np.unique(parent, return_index=True, return_counts=True)
    length[parents] += copies * word[index]
    old = group[parents]
    order = np.lexsort((copies, old))
    parents, copies, old = parents[order], copies[order], old[order]
    fresh = np.concatenate([[True], old[1:] != old[:-1]])
    head = np.flatnonzero(fresh)
    count = np.diff(np.append(head, len(parents)))
    start, stop = old[head], end[old[head]]
    target, _ = _ranges(stop - count, count)
    source = slot[parents]
    moved[source], wanted[target] = True, True
    taken, free = target[~moved[target]], source[~wanted[source]]
    others = sa[taken]
    moved[source], wanted[target] = False, False
    sa[free], slot[others] = others, free
    sa[target], slot[parents] = parents, target
    rest = stop - count > start
    end[start[rest]] = (stop - count)[rest]
    part = np.flatnonzero(fresh | np.concatenate([[True], copies[1:] != copies[:-1]]))
    size = np.diff(np.append(part, len(parents)))
    end[target[part]] = target[part] + size
    group[parents] = np.repeat(target[part], size)


def suffix_arrays(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions of all blocks, each block's slots in suffix order.

    Suffixes are compared up to their string's separator; equal ones are in any order.
    The separators' own suffixes come first and are in no order.
    """
    sa, slot, length, end = lyndon_groups(text, bounds)
    n = len(text)
    block = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    head = np.flatnonzero(end[:n])
    # starts of groups that are still valid: each begins where the one before ends
    head = head[np.concatenate([[True], head[1:] >= end[head[:-1]]])] if len(head) else head
    size = end[head] - head
    many = (size > 1) & (text[sa[head]] != 0)
    head, size = head[many], size[many]
    turn = np.arange(len(head)) - np.searchsorted(block[head], block[head])  # slots of a block are its positions
    order = np.argsort(turn, kind="stable")
    head, size = head[order], size[order]
    steps = np.searchsorted(turn[order], np.arange(turn.max() + 2)) if len(turn) else np.zeros(1, np.int64)
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
        first, many = head[a:b], size[a:b]
        at, owner = _ranges(first, many)
        member = sa[at]
        low, high = first[owner], (first + many)[owner]
        follow = member + length[member]
        depth = np.zeros(len(member), np.int64)
        rank = np.where(text[follow] == 0, -1, slot[follow])
        same = np.flatnonzero((rank >= low) & (rank < high))
        while len(same):
            depth[same] += 1
            follow[same] += length[member[same]]
            rank[same] = np.where(text[follow[same]] == 0, -1, slot[follow[same]])
            same = same[(rank[same] >= low[same]) & (rank[same] < high[same])]
        ordered = member[np.lexsort((rank, depth, owner))]
        sa[at] = ordered
        slot[ordered] = at
    return sa
