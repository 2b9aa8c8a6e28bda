"""Longest common prefixes up to a bound, from a Burrows-Wheeler transform by interval expansion.

The suffixes of a block are sorted to the depth that is needed. From their transform the intervals of all
strings are found breadth first: an interval of the string w, extended backward by a character c, is the
interval of cw. Level by level this gives the common prefixes of neighbouring suffixes by increasing value: a
right border that is reached first on level l has the value l, and only the interval that reached it goes on.
Expansion stops at the minimum length; borders not reached by then have common prefixes at least that long.
"""

from __future__ import annotations

import numpy as np


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` (small integers), in the order of their first ``depth`` symbols or more."""
    n = len(text)
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = text.astype(np.uint64) + np.uint64(1)
    key = (padded[:n] << np.uint64(36)) | (padded[1 : n + 1] << np.uint64(24)) | (padded[2 : n + 2] << np.uint64(12)) | padded[3 : n + 3]
    known = 4
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.empty(n, np.int64)
        new[0] = 1
        np.cumsum(ranked[1:] != ranked[:-1], out=new[1:])
        new[1:] += 1
        if known >= depth or new[-1] == n:
            return order
        rank = np.zeros(n + known, np.int64)
        rank[order] = new
        key = (rank[:n] << 32) | rank[known : n + known]
        known *= 2


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """Per place of ``text``: whether the ``length`` symbols that begin there also begin at another place.

    Symbols are integers below 4094. Places less than ``length`` before the end of the text are never repeated.
    """
    out = np.zeros(len(text), bool)
    if len(text) < 2:
        return out
    text = np.append(text.astype(np.int64) + 1, 0)  # ends in the smallest symbol, which stands nowhere else
    n = len(text)
    order = sort_suffixes(text, length + 1)
    before = text[order - 1]  # the transform
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # where a suffix goes when its preceding symbol is put in front
    step[by_symbol] = np.arange(n)
    first = np.empty(n + 2, np.int64)  # first symbols of the sorted suffixes, with sentinels at both ends
    first[1:-1] = before[by_symbol]
    first[[0, -1]] = -1
    short = np.zeros(n + 1, bool)  # border j lies before the suffix j; true once its common prefix is known
    short[[0, n]] = True
    tag = np.full(n + 2, -1, np.int64)
    used = 0
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        size = hi - lo
        offset = np.concatenate([[0], np.cumsum(size)[:-1]])
        number = np.repeat(np.arange(len(lo)), size)
        place = np.arange(len(number)) - offset[number] + lo[number]
        to = step[place]
        tag[to + 1] = number + used
        used += len(lo)
        mine, symbol = tag[to + 1], first[to + 1]
        ends = np.sort(to[(tag[to + 2] != mine) | (first[to + 2] != symbol)]) + 1
        starts = np.sort(to[(tag[to] != mine) | (first[to] != symbol)])
        fresh = ~short[ends]
        short[ends] = True
        lo, hi = starts[fresh], ends[fresh]
        if not len(lo):
            break
    found = np.empty(n, bool)
    found[order] = ~short[:-1] | ~short[1:]
    out[: max(0, len(out) - length + 1)] = found[: max(0, len(out) - length + 1)]
    return out
