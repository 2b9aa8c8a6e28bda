"""Jaccard join of two lists of sets with a prefix tree.

Sets are sequences in one order, the most frequent elements first, and lie in a compressed tree: sets with a
common beginning share its path. A query walks down level by level. What it has in common with a path is
added up once for all sets below, and a subtree is left as soon as the overlap so far and the elements that
remain, on either side, are too few for its smallest set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def ordered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets as ascending ranks, rank 0 for the most frequent element; elements of one set only are left out."""
    if not sets:
        return [], 0
    sizes = [len(s) for s in sets]
    element, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(element), np.int64)
    rank[np.lexsort((element, -count))] = np.arange(len(element))
    shared = int((count > 1).sum())
    out, at = [], 0
    for n in sizes:
        own = np.sort(rank[place[at : at + n]])
        out.append(own[: np.searchsorted(own, shared)])
        at += n
    return out, shared


class PrefixTree:
    """A compressed tree over sequences of ascending ranks."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">u4").tobytes())
        self.sizes = sizes
        parent, begin, end, source = [-1], [0], [0], [-1]  # a node's run is source[begin:end]
        ends_here: list[list[int]] = [[]]
        path = [0]
        before = np.zeros(0, np.int64)
        for i in order:
            seq = sequences[i]
            m = min(len(seq), len(before))
            differ = np.flatnonzero(seq[:m] != before[:m])
            common = int(differ[0]) if len(differ) else m
            while end[path[-1]] > common and begin[path[-1]] >= common:
                path.pop()
            top = path[-1]
            if end[top] > common:  # the run is split at the common beginning
                mid = len(parent)
                parent.append(parent[top])
                begin.append(begin[top])
                end.append(common)
                source.append(source[top])
                ends_here.append([])
                parent[top], begin[top] = mid, common
                path[-1] = top = mid
            if len(seq) > common:
                parent.append(top)
                begin.append(common)
                end.append(len(seq))
                source.append(i)
                ends_here.append([])
                top = len(parent) - 1
                path.append(top)
            ends_here[top].append(i)
            before = seq
        self._arrays(sequences, np.array(parent), np.array(begin), np.array(end), source, ends_here)

    def _arrays(self, sequences, parent, begin, end, source, ends_here) -> None:
        """Nodes level by level, their runs in one pool, and bounds over the sets below each."""
        n = len(parent)
        depth = np.zeros(n, np.int64)
        by_end = np.argsort(end, kind="stable")  # a parent ends before its children
        for v in by_end[1:].tolist():
            depth[v] = depth[parent[v]] + 1
        order = np.lexsort((parent, depth))
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        order = np.lexsort((number[parent], depth))
        number[order] = np.arange(n)
        self.parent = np.where(parent[order] < 0, -1, number[parent[order]])
        self.level_of = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        runs = [sequences[source[v]][begin[v] : end[v]] if source[v] >= 0 else np.zeros(0, np.int64) for v in order]
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        self.pool = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        self.end = end[order]
        self.last = np.array([r[-1] if len(r) else -1 for r in runs])
        self.sets = [ends_here[v] for v in order]
        smallest, longest = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        for v, own in enumerate(self.sets):
            for i in own:
                smallest[v], longest[v] = min(smallest[v], self.sizes[i]), max(longest[v], len(sequences[i]))
        for v in range(n - 1, 0, -1):
            p = self.parent[v]
            smallest[p], longest[p] = min(smallest[p], smallest[v]), max(longest[p], longest[v])
        self.smallest, self.longest = smallest, longest
        # children of a node are neighbours, as nodes are sorted by level and parent
        self.child = np.searchsorted(self.parent[1:], np.arange(n), "left") + 1
        self.child_end = np.searchsorted(self.parent[1:], np.arange(n), "right") + 1

    def search(self, query: np.ndarray, size: int, num: int, den: int, shared: int) -> Iterator[tuple[int, int]]:
        """(set, overlap) of all sets with ``den * overlap >= num * union``."""
        has = np.zeros(shared + 1, np.int64)
        has[query] = 1
        alive, overlap = np.array([0]), np.array([0])
        while len(alive):
            for v, o in zip(alive.tolist(), overlap.tolist()):
                for i in self.sets[v]:
                    if den * o >= num * (size + int(self.sizes[i]) - o) and o:
                        yield i, o
            count = self.child_end[alive] - self.child[alive]
            total = int(count.sum())
            if not total:
                return
            above = np.repeat(np.arange(len(alive)), count)
            node = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + self.child[alive][above]
            length = self.start[node + 1] - self.start[node]
            at = np.cumsum(length) - length
            spots = np.arange(int(length.sum())) - np.repeat(at - self.start[node], length)
            overlap = overlap[above] + np.add.reduceat(has[self.pool[spots]], at)
            left = np.minimum(self.longest[node] - self.end[node], len(query) - np.searchsorted(query, self.last[node], "right"))
            best = overlap + left
            keep = den * best >= num * (size + self.smallest[node] - best)
            alive, overlap = node[keep], overlap[keep]


def linked(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of sets with Jaccard similarity of at least num / den that together connect all that are linked.

    ``side`` 0 and 1: pairs have one set of each; if all are 0, any two sets. Sets that are connected already
    are not reported again.
    """
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(s) for s in sets], np.int64)
    sequences, shared = ordered(sets)
    one = not side.any()
    stored = list(range(len(sets))) if one else np.flatnonzero(side == 1).tolist()
    asked = list(range(len(sets))) if one else np.flatnonzero(side == 0).tolist()
    if not stored or not asked:
        return []
    tree = PrefixTree([sequences[i] for i in stored], sizes[stored])
    out, parts = [], len(sets)
    for q in asked:
        if parts == 1:
            break
        for found, _ in tree.search(sequences[q], int(sizes[q]), num, den, shared):
            a, b = find(q), find(stored[found])
            if a != b:
                root[a] = b
                parts -= 1
                out.append((q, stored[found]))
    return out
