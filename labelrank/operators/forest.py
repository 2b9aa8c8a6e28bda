"""Random forest without a depth limit, as a Spark ML estimator, and its feature importances.

Features are cut into quantile bins; rows with equal bins become one row with its counts per class, so copies cost
nothing and a hot row is no hot task. How often a tree draws a row is Poisson with mean one per copy, from a hash of
the bins and the tree; the features that a node looks at come from a hash of the node's path. So a tree does not
depend on how rows are dealt, on retries, or on which of two ways it grows:

* A table of at most ``smallBytes`` (measured) is broadcast, and each task grows whole trees.
* A larger one goes through a queue of nodes. The upper nodes of a batch of trees are split by shared counts of
  (node, feature, bin), added up in the tasks first. Nodes of at most ``nodeRows`` drawn rows are finished by one task
  each, which gets only their rows.

Splits lower the Gini impurity most. As long as a node is mixed, large enough and not all alike, it is split: it looks
at ``sqrt`` of the features, and at further ones only while none of these can split it. Ties go to the feature that
comes first in the node's own order, then to the lowest cut.

The trees of a model grow with the rows. Up to ``heldBytes`` (measured) they come to the driver and are broadcast for
scoring. Larger ones stay in a stored table, which the driver never sees: distinct vectors meet the trees part by part,
and each task adds up the shares of its trees. ``modelBytes`` is a bound for callers who want fitting to fail beyond it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelrank.operators.boosting import _binned, _mixed, _quantiles, flattened, reached
from labelrank.operators.paths import SharedPath
from labelrank.operators.saving import SavedModel
from labelrank.session import discard, scratch_path, staged

_ARRAYS = "feature array<int>, cut array<double>, left array<int>, right array<int>, value array<double>"
_TREES = f"tree int, {_ARRAYS}"
_U = np.uint64
#: Chances that a copy of a row is drawn at most 0, 1, 2, ... times.
_AT_MOST = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
#: Copies of a row that are drawn one by one, and beyond that the powers of two that are drawn at once.
_FEW, _POWERS = 16, 16
#: Rows of a level from which nodes of many rows and of few are counted apart.
_SPLIT_ROWS = 1 << 15
#: Open nodes that are counted by one job; bounds the counts that a task holds.
_BLOCK = 2_000
_NAMES = ["feature", "cut", "left", "right", "value"]
#: Bytes of a tree's node, and of the trees and the vectors that meet in one task.
_NODE, _PART, _POINTS = 28, 1 << 25, 1 << 26


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    min_split: int
    min_rows: int
    looked_at: int
    bootstrap: bool
    seed: int


def _root(s: Settings, tree: int) -> int:
    return int(_mixed(np.array([s.seed * 1_000_003 + tree + 1], _U))[0])


def _children(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _mixed(keys * _U(2) + _U(1)), _mixed(keys * _U(2) + _U(2))


def _order(keys: np.ndarray, features: int) -> np.ndarray:
    """Nodes x features: the order in which each node looks at the features."""
    salt = _mixed(np.arange(1, features + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return np.argsort(_mixed(keys[:, None] ^ salt[None, :]), axis=1, kind="stable")


def _chances(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return (_mixed(key ^ salt) >> _U(11)).astype(np.float64) / 2**53


@cache
def _poisson(power: int) -> tuple[int, np.ndarray]:
    """Chances that 2**power copies are drawn at most so many times, from a first number on that is hardly ever missed."""
    mean = 2.0**power
    first = max(0, int(mean - 12 * mean**0.5))
    times = range(first, int(mean + 12 * mean**0.5) + 32)
    return first, np.cumsum([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in times])


def _draw(key: np.ndarray, copies: np.ndarray, root: int, kind: int) -> np.ndarray:
    """How often a tree draws rows with so many copies."""
    few = copies <= _FEW
    times = np.where(few, copies, 0)
    row = np.repeat(np.arange(len(key)), times)
    copy = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    salt = _mixed(_U(root) ^ (copy.astype(_U) * _U(2) + _U(kind)))
    out = np.bincount(row, np.searchsorted(_AT_MOST, _chances(key[row], salt), "right"), len(key)).astype(np.int64)
    # the draws of many copies are the sum of those of the powers of two that make them up
    for power in range(_POWERS if not few.all() else 0):
        some = np.flatnonzero(~few & (copies >> power & 1 > 0))
        first, at_most = _poisson(power)
        salt = _mixed(np.array([_U(root) ^ _U(2 * (_FEW + power) + kind)]))
        out[some] += first + np.searchsorted(at_most, _chances(key[some], salt), "right")
    for i in np.flatnonzero(copies >> _POWERS):  # too few rows to matter
        out[i] += np.random.default_rng([int(key[i]), root, kind]).poisson(float(copies[i] >> _POWERS << _POWERS))
    return out


def draws(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, root: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    return (_draw(key, n0, root, 0), _draw(key, n1, root, 1)) if s.bootstrap else (n0, n1)


def _purity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows less their Gini impurity; the higher its sum over the sides, the better a split."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * a + b * b) / np.maximum(a + b, 1)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


def _best_cuts(cell: np.ndarray, a: np.ndarray, b: np.ndarray, nodes: int, s: Settings):
    """Best cut of each node from counts by (node x 256 + bin), ascending, cells distinct:
    (worth or -inf, bin, rows of either class below)."""
    node = cell >> 8
    edge = _starts(node)
    span = np.diff(edge, append=len(cell))
    below = [np.cumsum(v) for v in (a, b)]
    start = [(c - v)[edge] for c, v in zip(below, (a, b))]
    last = edge + span - 1
    l0, l1 = (c - np.repeat(z, span) for c, z in zip(below, start))
    r0, r1 = (np.repeat(c[last], span) - c for c in below)
    worth = _purity(l0, l1) + _purity(r0, r1)
    if s.min_rows > 1:
        worth[(l0 + l1 < s.min_rows) | (r0 + r1 < s.min_rows)] = -np.inf
    worth[last] = -np.inf  # nothing is above the last bin; no other side is empty
    top = np.maximum.reduceat(worth, edge) if len(edge) else np.zeros(0)
    hits = np.flatnonzero(worth == np.repeat(top, span))
    first = hits[np.searchsorted(hits, edge)] if len(edge) else hits
    out = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    at = node[edge]
    out[0][at], out[1][at], out[2][at], out[3][at] = top, cell[first] & 255, l0[first], l1[first]
    return out


class _Counter:
    """Counts of either class by cell, for rows with these weights."""

    def __init__(self, w0: np.ndarray, w1: np.ndarray):
        self.w0, self.w1 = w0, w1
        # both in one number while their sums have room in it, exact in any order
        self.both = w0 + w1 * float(1 << 26) if max(w0.sum(), w1.sum()) < 1 << 26 else None
        light = max(w0.max(initial=0), w1.max(initial=0)) < 1 << 16
        self.low = (w0 << 16 | w1).astype(_U) if light else None

    def by_place(self, cell: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every cell; for cells that are few."""
        if self.both is None:
            a, b = (np.bincount(cell, w.take(rows), size).astype(np.int64) for w in (self.w0, self.w1))
            return a, b
        total = np.bincount(cell, self.both.take(rows), size).astype(np.int64)
        return total & (1 << 26) - 1, total >> 26

    def by_order(self, cell: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells that have rows, in order, their counts)."""
        # sorted with what is to be added up, or with where it is if that takes more bits
        packed = cell.astype(_U) << _U(32)
        packed |= np.arange(len(cell), dtype=_U) if self.low is None else self.low.take(rows)
        packed.sort()
        cell, own = (packed >> _U(32)).astype(np.int64), (packed & _U(0xFFFFFFFF)).astype(np.int64)
        a, b = (self.w0[rows[own]], self.w1[rows[own]]) if self.low is None else (own >> 16, own & 0xFFFF)
        edge = _starts(cell)
        return cell[edge], np.add.reduceat(a, edge), np.add.reduceat(b, edge)


def _cuts_of(f: np.ndarray, p: np.ndarray, code: np.ndarray, r: np.ndarray, bins: np.ndarray, held: np.ndarray, counter: _Counter, s: Settings):
    """``_best_cuts`` of nodes that look at the features ``f``, from the bins of their rows ``r``, in one or two parts:
    bins of a node with many rows have a place each, those of the others are sorted."""
    nodes, span = len(f), bins[f]
    if len(p) >= _SPLIT_ROWS:
        few = span > 4 * held
    else:  # too few rows to gain by telling them apart
        few = np.full(nodes, int(span[held > 0].sum()) > 4 * len(p))
    if few.any():
        span = np.where(few, 0, span)
        sparse = few.take(p)
        r_few = np.flatnonzero(sparse)
        if len(r_few):
            cell, a, b = counter.by_order(p.take(r_few) << 8 | code.take(r_few), r.take(r_few))
            yield _best_cuts(cell, a, b, nodes, s)
        many = np.flatnonzero(~sparse)
        p, code, r = p.take(many), code.take(many), r.take(many)
    if len(p):
        end = np.cumsum(span)
        start = end - span
        a, b = counter.by_place(start.take(p) + code, r, int(end[-1]))
        at = np.flatnonzero(a + b)
        node = np.repeat(np.arange(nodes), span)[at]
        yield _best_cuts((node << 8) + at - start[node], a[at], b[at], nodes, s)


def grow(codes: np.ndarray, w0: np.ndarray, w1: np.ndarray, key: int, depth: int, s: Settings):
    """A tree (or the part of one below a node with this key and depth) over the drawn rows, all nodes of a level at once:
    (feature or -1, bin, left, right, share of class 1, importance of each feature)."""
    width, w0, w1 = codes.shape[1], np.asarray(w0, np.int64), np.asarray(w1, np.int64)
    rows = np.flatnonzero(w0 + w1)
    place = np.zeros(len(rows), np.int64)
    feature, cut, left, right, share = ([] for _ in range(5))
    importance = np.zeros(width)
    flat, counter, bins = np.ascontiguousarray(codes).reshape(-1), _Counter(w0, w1), codes.max(axis=0, initial=0).astype(np.int64) + 1
    keys, born = np.array([key], _U), 1
    while len(keys):
        n0, n1 = counter.by_place(place, rows, len(keys))
        n = n0 + n1
        waits = (n0 > 0) & (n1 > 0) & (n >= s.min_split) & (s.depth <= 0 or depth < s.depth)
        best, chosen, at, l0, l1 = np.full(len(keys), -np.inf), *(np.zeros(len(keys), np.int64) for _ in range(4))
        order = np.zeros((len(keys), width), np.int64)
        if waits.any():
            order[waits] = _order(keys[waits], width)
        if not waits.all():
            keep = np.flatnonzero(waits.take(place))
            rows, place = rows.take(keep), place.take(keep)
        p, r, held = place, rows, np.bincount(place, None, len(keys))
        for k in range(width):
            if k % s.looked_at == 0 and k:  # further features only for nodes that none could split so far
                waits &= ~np.isfinite(best)
                keep = waits[p]
                p, r = p[keep], r[keep]
            if not len(p):
                break
            f = np.ascontiguousarray(order[:, k])
            code = flat.take(r * width + f.take(p))
            for found in _cuts_of(f, p, code, r, bins, held, counter, s):
                better = found[0] > best
                best[better], chosen[better] = found[0][better], f[better]
                at[better], l0[better], l1[better] = found[1][better], found[2][better], found[3][better]
        good = np.isfinite(best)
        np.add.at(importance, chosen[good], best[good] - _purity(n0[good], n1[good]))
        number = np.cumsum(good) - 1
        feature.append(np.where(good, chosen, -1))
        cut.append(at)
        left.append(np.where(good, born + 2 * number, -1))
        right.append(np.where(good, born + 2 * number + 1, -1))
        share.append(n1 / np.maximum(n, 1))
        if not good.all():
            keep = np.flatnonzero(good.take(place))
            rows, place = rows.take(keep), place.take(keep)
        place = 2 * number.take(place) + (flat.take(rows * width + chosen.take(place)) > at.take(place))
        keys = np.stack(_children(keys[good]), axis=1).ravel()
        born += len(keys)
        depth += 1
    return *(np.concatenate(v) for v in (feature, cut, left, right, share)), importance


def _arrays(batch: pa.RecordBatch | pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """(codes, key, n0, n1) of rows of the binned table."""
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, width)
    return codes, *(batch.column(c).to_numpy() if isinstance(batch, pa.Table) else batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n0", "n1"))


class _Top:
    """The upper nodes of one tree while the queue works on them."""

    def __init__(self, root: int):
        self.feature, self.bin, self.left, self.right = [-1], [0], [-1], [-1]
        self.key, self.depth, self.value = [root], [0], [0.0]

    def split(self, node: int, feature: int, b: int) -> tuple[int, int]:
        at = len(self.feature)
        for child in _children(np.array([self.key[node]], _U)):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.key.append(int(child[0]))
            self.depth.append(self.depth[node] + 1)
            self.value.append(0.0)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, b, at, at + 1
        return at, at + 1

    def routes(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(v, np.int64) for v in (self.feature, self.bin, self.left, self.right))


def _routed(codes: np.ndarray, routes: tuple[np.ndarray, ...]) -> np.ndarray:
    feature, b, left, right = routes
    node = np.zeros(len(codes), np.int64)
    row = np.arange(len(codes))
    while (inner := feature[node] >= 0).any():
        under = codes[row, np.maximum(feature[node], 0)] <= b[node]
        node = np.where(inner, np.where(under, left[node], right[node]), node)
    return node


class _Queue:
    """Upper nodes by shared counts, small nodes by tasks, for one batch of trees over a stored binned table."""

    def __init__(self, binned: DataFrame, width: int, s: Settings, trees: range, node_rows: int):
        self.binned, self.width, self.s, self.node_rows = binned, width, s, node_rows
        self.tops = {t: _Top(_root(s, t)) for t in trees}
        self.importance = {t: np.zeros(width) for t in trees}

    def _counts(self, block: list[tuple[int, int, int]]) -> dict[int, dict]:
        """The best split of each (tree, node, features passed over) by its place in the block."""
        sc, width, s = self.binned.sparkSession.sparkContext, self.width, self.s
        trees = sorted({t for t, _, _ in block})
        orders = {(t, v): (i, _order(np.array([self.tops[t].key[v]], _U), width)[0][skip : skip + s.looked_at]) for i, (t, v, skip) in enumerate(block)}
        held = sc.broadcast(({t: self.tops[t].routes() for t in trees}, orders))
        slots = s.looked_at

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            routes, wanted = held.value
            out = np.zeros((2, len(wanted) * slots * 256), np.int64)
            for batch in batches:
                codes, key, n0, n1 = _arrays(batch, width)
                for t, route in routes.items():
                    w = draws(key.view(_U), n0, n1, _root(s, t), s)
                    node = _routed(codes, route)
                    index, features = np.full(len(route[0]), -1), np.full((len(route[0]), slots), -1)
                    for (tree, v), (i, order) in wanted.items():
                        if tree == t:
                            index[v] = i
                            features[v, : len(order)] = order
                    r = np.flatnonzero((index[node] >= 0) & (w[0] + w[1] > 0))
                    for j in range(slots):
                        f = features[node[r], j]
                        q = r[f >= 0]
                        cell = (index[node[q]] * slots + j) * 256 + codes[q, f[f >= 0]]
                        for i in (0, 1):
                            np.add.at(out[i], cell, w[i][q])
            some = np.flatnonzero(out.sum(axis=0))
            yield pa.RecordBatch.from_pydict({
                "node": some // (slots * 256), "cell": some % (slots * 256), "a": out[0][some], "b": out[1][some]})

        def best(found: pd.DataFrame) -> pd.DataFrame:
            found = found.sort_values("cell")
            cell, a, b = (found[c].to_numpy() for c in ("cell", "a", "b"))
            worth, at, l0, l1 = _best_cuts(cell, a, b, slots, s)
            slot = int(np.argmax(worth))
            first = cell >> 8 == 0
            return pd.DataFrame({
                "node": found["node"].iloc[:1], "slot": slot, "worth": worth[slot], "at": at[slot], "l0": l0[slot], "l1": l1[slot],
                "n0": a[first].sum(), "n1": b[first].sum()})

        summed = self.binned.mapInArrow(count, "node long, cell long, a long, b long").groupBy("node", "cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        rows = summed.groupBy("node").applyInPandas(best, "node long, slot int, worth double, at int, l0 long, l1 long, n0 long, n1 long").collect()
        held.destroy()
        return {r["node"]: {**r.asDict(), "feature": int(orders[block[r["node"]][:2]][1][r["slot"]])} for r in rows}

    def run(self) -> list[tuple[int, int]]:
        """Split the upper nodes; (tree, node) of the small ones that are left."""
        s, opened, small = self.s, [(t, 0, 0) for t in self.tops], []
        while opened:
            following = []
            for lo in range(0, len(opened), _BLOCK):
                block = opened[lo : lo + _BLOCK]
                found = self._counts(block)
                for i, (t, v, skip) in enumerate(block):
                    r, top = found.get(i), self.tops[t]
                    if r is None:
                        continue
                    n0, n1 = r["n0"], r["n1"]
                    top.value[v] = n1 / (n0 + n1)
                    if not self._mixed(n0, n1, top.depth[v]):
                        continue
                    if r["worth"] == -np.inf:
                        if skip + s.looked_at < self.width:
                            following.append((t, v, skip + s.looked_at))
                        continue
                    self.importance[t][r["feature"]] += r["worth"] - float(_purity(np.array([n0]), np.array([n1]))[0])
                    sides = (r["l0"], r["l1"]), (n0 - r["l0"], n1 - r["l1"])
                    for child, (a, b) in zip(top.split(v, r["feature"], r["at"]), sides):
                        top.value[child] = b / (a + b)
                        if self._mixed(a, b, top.depth[child]):
                            if a + b > self.node_rows:
                                following.append((t, child, 0))
                            else:
                                small.append((t, child))
            opened = following
        return small

    def _mixed(self, a: int, b: int, depth: int) -> bool:
        return a > 0 and b > 0 and a + b >= self.s.min_split and (self.s.depth <= 0 or depth < self.s.depth)

    def subtrees(self, small: list[tuple[int, int]]) -> DataFrame:
        """(tree, node, arrays of the part below it, importance): each small node finished by one task from its rows."""
        spark, width, s = self.binned.sparkSession, self.width, self.s
        wanted = {t: [v for u, v in small if u == t] for t in {t for t, _ in small}}
        held = spark.sparkContext.broadcast({
            t: (self.tops[t].routes(), np.array(vs), {v: (self.tops[t].key[v], self.tops[t].depth[v]) for v in vs}) for t, vs in wanted.items()})

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, key, n0, n1 = _arrays(batch, width)
                for t, (routes, vs, _) in held.value.items():
                    w0, w1 = draws(key.view(_U), n0, n1, _root(s, t), s)
                    node = _routed(codes, routes)
                    r = np.flatnonzero(np.isin(node, vs) & (w0 + w1 > 0))
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array(np.full(len(r), t), pa.int32()), "node": pa.array(node[r], pa.int32()),
                        "codes": batch.column("codes").take(pa.array(r)).cast(pa.binary()), "w0": w0[r], "w1": w1[r]})

        def finish(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            t, v = int(keys[0]), int(keys[1])
            key, depth = held.value[t][2][v]
            codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(-1, width)
            *part, importance = grow(codes, rows["w0"].to_numpy(), rows["w1"].to_numpy(), key, depth, s)
            return pd.DataFrame({"tree": [t], "node": [v], **{c: [a.tolist()] for c, a in zip(_NAMES, part)}, "importance": [importance.tolist()]})

        dealt = self.binned.mapInArrow(deal, "tree int, node int, codes binary, w0 long, w1 long")
        return dealt.groupBy("tree", "node").applyInPandas(finish, f"tree int, node int, {_ARRAYS}, importance array<double>")


class _ForestParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "deepest level of a tree; 0 for no limit", TypeConverters.toInt)
    minSplit = Param(Params._dummy(), "minSplit", "drawn rows of a node that is split, at least", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "drawn rows of a child at least", TypeConverters.toInt)
    subset = Param(Params._dummy(), "subset", "features that a node looks at first: sqrt or all", TypeConverters.toString)
    bootstrap = Param(Params._dummy(), "bootstrap", "draw rows for each tree, or take all", TypeConverters.toBoolean)
    maxBins = Param(Params._dummy(), "maxBins", "quantile bins of a feature, 255 at most", TypeConverters.toInt)
    smallBytes = Param(Params._dummy(), "smallBytes", "a binned table up to this size is broadcast", TypeConverters.toInt)
    nodeRows = Param(Params._dummy(), "nodeRows", "drawn rows of a node that one task finishes, at most", TypeConverters.toInt)
    treeBatch = Param(Params._dummy(), "treeBatch", "trees of a larger table that grow at the same time", TypeConverters.toInt)
    modelBytes = Param(Params._dummy(), "modelBytes", "largest size of all trees of a model; 0 for any", TypeConverters.toInt)
    heldBytes = Param(Params._dummy(), "heldBytes", "trees up to this size come to the driver", TypeConverters.toInt)
    scoreCol = Param(Params._dummy(), "scoreCol", "probability of label 1", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(
            numTrees=100, maxDepth=0, minSplit=2, minInstancesPerNode=1, subset="sqrt", bootstrap=True, seed=42, maxBins=255,
            smallBytes=1 << 26, nodeRows=200_000, treeBatch=20, modelBytes=0, heldBytes=1 << 24, scoreCol="score")

    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)

    def settings(self, width: int) -> Settings:
        o = self.getOrDefault
        if o("subset") not in ("sqrt", "all"):
            raise ValueError("subset is sqrt or all")
        looked_at = width if o("subset") == "all" else max(1, math.isqrt(width))
        return Settings(o("numTrees"), o("maxDepth"), o("minSplit"), o("minInstancesPerNode"), looked_at, o("bootstrap"), o("seed") % 2**31)


class HistogramForest(SharedPath, Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on rows whose label is 0 or 1 (rows with a null label do not count); there must be one at least.

    Missing values lie above all others.
    """

    _length = "numTrees"
    _shared = ("numTrees", "maxDepth")

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=100, maxDepth=0, minSplit=2,
                 minInstancesPerNode=1, subset="sqrt", bootstrap=True, seed=42, maxBins=255, smallBytes=1 << 26, nodeRows=200_000,
                 treeBatch=20, modelBytes=0, heldBytes=1 << 24, scoreCol="score"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit_each(self, dataset: DataFrame, each: Sequence[HistogramForest]) -> list[HistogramForestModel]:
        """A tree of a lower depth is the upper part of the deepest one, since no choice of a node looks at the limit."""
        depths = [e.getMaxDepth() for e in each]
        deepest = 0 if min(depths) <= 0 else max(depths)
        longest = self.copy({self.numTrees: max(e.getNumTrees() for e in each), self.maxDepth: deepest})._fit(dataset)
        return [longest.part(e.getNumTrees(), 0 if d <= 0 or d == deepest else d) for e, d in zip(each, depths)]

    def _binned(self, dataset: DataFrame) -> tuple[DataFrame, list[np.ndarray], int, int]:
        """(stored table of bins with counts per class, edges, width, its rows)."""
        x, y = vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")
        rows = dataset.select(x, y).where("y is not null")
        facts = rows.agg(F.count("y").alias("n"), F.max(F.size("x")).alias("f"), F.min(F.size("x")).alias("g"), F.bool_and(F.col("y").isin(0.0, 1.0)).alias("ok")).first()
        if not facts["n"] or facts["f"] != facts["g"] or not facts["f"] or not facts["ok"]:
            raise ValueError("there must be rows with a label of 0 or 1, and vectors of one width")
        width, bins = facts["f"], min(255, self.getOrDefault(self.maxBins))
        edges = _quantiles(rows, width, bins)
        held = dataset.sparkSession.sparkContext.broadcast(edges)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = _binned(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), held.value)
                yield pa.RecordBatch.from_pydict({"codes": pa.array([c.tobytes() for c in codes], pa.binary()), "y": batch.column(1).cast(pa.int64())})

        counted = (
            rows.mapInArrow(coded, "codes binary, y long").groupBy("codes")
            .agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
            .select("codes", F.xxhash64("codes").alias("key"), "n0", "n1"))
        stored = staged(counted, "forest")
        return stored, edges, width, stored.count()

    def _grown(self, binned: DataFrame, edges: list[np.ndarray], width: int, s: Settings, kept: bool = True) -> DataFrame:
        """(tree, arrays) of all trees, each grown whole over the broadcast table; cuts are values. (tree, importance) if they are not ``kept``."""
        spark = binned.sparkSession
        whole = binned.toArrow()
        held = spark.sparkContext.broadcast((edges, *(np.ascontiguousarray(a) for a in _arrays(whole, width))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            edges, codes, key, n0, n1 = held.value
            for batch in batches:
                for t in batch["id"]:
                    root = _root(s, int(t))
                    w0, w1 = draws(key.view(_U), n0, n1, root, s)
                    if not (w0.any() or w1.any()):  # a tiny table of which nothing was drawn
                        w0, w1 = n0, n1
                    feature, b, *rest, importance = grow(codes, w0, w1, root, 0, s)
                    part = {c: [a] for c, a in zip(_NAMES, (feature, _values(feature, b, edges), *rest))} if kept else {"importance": [importance]}
                    yield pd.DataFrame({"tree": [t], **part})

        cores = spark.sparkContext.defaultParallelism
        return spark.range(0, s.trees, 1, min(s.trees, 4 * cores)).mapInPandas(run, _TREES if kept else "tree int, importance array<double>")

    def _small(self, rows: int, width: int) -> bool:
        return rows * (width + 24) <= self.getOrDefault(self.smallBytes)

    def _queues(self, binned: DataFrame, width: int, s: Settings) -> Iterator[tuple[_Queue, DataFrame | None]]:
        batch = self.getOrDefault(self.treeBatch)
        for lo in range(0, s.trees, batch):
            queue = _Queue(binned, width, s, range(lo, min(s.trees, lo + batch)), self.getOrDefault(self.nodeRows))
            small = queue.run()
            yield queue, queue.subtrees(small) if small else None

    def importances(self, dataset: DataFrame) -> list[float]:
        """Mean decrease of impurity by feature: shares within each tree, averaged over the trees that split at all.

        They add up to 1, or are all 0 if no tree splits. No tree leaves its task.
        """
        binned, edges, width, rows = self._binned(dataset)
        s = self.settings(width)
        sums = [F.sum(F.col("importance")[j]).alias(f"i{j}") for j in range(width)]
        try:
            if self._small(rows, width):
                found = [np.array(r[1:]) for r in self._grown(binned, edges, width, s, kept=False).groupBy("tree").agg(*sums).orderBy("tree").collect()]
            else:
                found = []
                for queue, parts in self._queues(binned, width, s):
                    for r in parts.groupBy("tree").agg(*sums).collect() if parts is not None else []:
                        queue.importance[r["tree"]] += np.array(r[1:])
                    found += queue.importance.values()
        finally:
            discard(binned)
        shares = [v / v.sum() for v in found if v.sum() > 0]
        return (np.mean(shares, axis=0) if shares else np.zeros(width)).tolist()

    def _fit(self, dataset: DataFrame) -> HistogramForestModel:
        binned, edges, width, rows = self._binned(dataset)
        s, spark, most = self.settings(width), dataset.sparkSession, self.getOrDefault(self.modelBytes)
        path, size = scratch_path(spark, "trees"), 0
        stored = spark.read.schema(_TREES)
        done = False
        try:
            if self._small(rows, width):
                grown = [self._grown(binned, edges, width, s)]
            else:
                grown = (_whole(queue, parts, edges) for queue, parts in self._queues(binned, width, s))
            for some in grown:
                some.write.mode("append").parquet(path)
                size = _size(stored.parquet(path))
                if 0 < most < size:
                    raise ValueError(f"trees of {size} bytes; raise minSplit or modelBytes, or set maxDepth")
            trees = stored.parquet(path)
            held = size <= self.getOrDefault(self.heldBytes)
            model = self._copyValues(HistogramForestModel(trees.toArrow().sort_by("tree") if held else trees))
            done = not held
        finally:
            discard(binned)
            if not done and size:
                discard(stored.parquet(path))
        return model


def _size(trees: DataFrame) -> int:
    return _NODE * (trees.agg(F.sum(F.size("feature"))).first()[0] or 0)


def _values(feature: np.ndarray, b: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The values that the nodes of a tree cut at, from their bins."""
    start, values = np.cumsum([0] + [len(e) for e in edges[:-1]]), np.append(np.concatenate(edges), 0.0)
    return values[np.where(feature >= 0, start[feature] + b.astype(np.int64), -1)]


def _whole(queue: _Queue, parts: DataFrame | None, edges: list[np.ndarray]) -> DataFrame:
    """The trees of a batch, each put together by one task from its upper nodes and the parts below."""
    spark, schema = queue.binned.sparkSession, f"tree int, node int, {_ARRAYS}"
    tops = spark.createDataFrame([
        (t, -1, *([float(x) if c in ("cut", "value") else int(x) for x in v] for c, v in zip(_NAMES, (q.feature, q.bin, q.left, q.right, q.value))))
        for t, q in queue.tops.items()], schema)
    held = spark.sparkContext.broadcast(edges)
    every = tops if parts is None else tops.unionByName(parts.select("tree", "node", *_NAMES))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        top, *below = zip(*(rows[c] for c in ("node", *_NAMES)))
        feature, b, *rest = _joined(top[1:], below)
        tree = feature, _values(feature, b, held.value), *rest
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], **{c: [v] for c, v in zip(_NAMES, tree)}})

    return every.groupBy("tree").applyInPandas(join, _TREES)


def _joined(top: Sequence[np.ndarray], below: Sequence[tuple]) -> list[np.ndarray]:
    """The arrays of a tree from its upper nodes and the parts below its small ones, which come by node."""
    out = [[np.array(v)] for v in top]
    born = len(top[0])
    for node, *part in below:
        # the root of the part takes the small node's place, its other nodes come behind
        feature, cut, left, right, value = part
        moved = feature, cut, *(np.where(side > 0, side + born - 1, side) for side in (left, right)), value
        for own, new in zip(out, moved):
            own[0][node] = new[0]
            own.append(new[1:])
        born += len(feature) - 1
    return [np.concatenate(v) for v in out]


def _cut_off(tree: Sequence[np.ndarray], depth: int) -> list[np.ndarray]:
    """The arrays of a tree without what lies below this depth."""
    feature, cut, left, right, value = tree
    level, nodes = np.full(len(feature), depth + 1), np.zeros(1, np.int64)
    for d in range(depth + 1):
        level[nodes] = d
        nodes = nodes[feature[nodes] >= 0]
        nodes = np.concatenate([left[nodes], right[nodes]])
    keep = level <= depth
    number, inner = np.cumsum(keep) - 1, (feature >= 0) & (level < depth)
    out = np.where(inner, feature, -1), np.where(inner, cut, 0.0), *(np.where(inner, number[side], -1) for side in (left, right)), value
    return [v[keep] for v in out]


def _flat(trees: Sequence[Sequence[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """All trees as one: (roots, feature, cut, left, right, value)."""
    sizes = np.array([len(t[0]) for t in trees])
    start = np.cumsum(sizes) - sizes
    own = np.repeat(start, sizes).astype(np.int32)
    feature, cut, left, right, value = (np.concatenate(v) for v in zip(*trees))
    return start, feature, cut, left + own, right + own, value


class HistogramForestModel(Model, _ForestParams, SavedModel):
    """The score is the mean share of label 1 in the leaves that a row reaches."""

    def __init__(self, trees: pa.Table | DataFrame):
        super().__init__()
        self._held, self._stored = (trees, None) if isinstance(trees, pa.Table) else (None, trees)

    @property
    def trees(self) -> pa.Table:
        """All trees, which come to the driver if they are stored."""
        return self._held if self._held is not None else self._stored.toArrow().sort_by("tree")

    def part(self, trees: int, depth: int = 0) -> HistogramForestModel:
        """The first trees, without what lies below ``depth`` (0: whole)."""
        if self._held is None:
            some = self._stored.where(F.col("tree") < trees)
            return HistogramForestModel(some.mapInPandas(self._lower(depth), _TREES) if depth else some)
        some = self._held.slice(0, trees)
        if depth:
            cut = list(self._lower(depth)(iter([some.to_pandas()])))[0]
            some = pa.table({c: pa.array([list(v) for v in cut[c]] if c in _NAMES else cut[c], some.schema.field(c).type) for c in cut}, some.schema)
        return HistogramForestModel(some)

    @staticmethod
    def _lower(depth: int):
        def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                some = [_cut_off(t, depth) for t in zip(*(batch[c] for c in _NAMES))]
                yield pd.DataFrame({"tree": batch["tree"], **dict(zip(_NAMES, map(list, zip(*some))))})

        return lower

    def _save_parts(self, path: str) -> None:
        trees = self._stored if self._held is None else SparkSession.active().createDataFrame(self._held)
        trees.write.parquet(f"{path}/trees")

    @classmethod
    def _restore(cls, fitted: dict, path: str, spark) -> HistogramForestModel:
        trees = spark.read.schema(_TREES).parquet(f"{path}/trees")
        return cls(trees.toArrow().sort_by("tree") if _size(trees) <= 1 << 24 else trees)

    def _flat(self) -> tuple[np.ndarray, ...]:
        columns = [self._held[c].combine_chunks() for c in _NAMES]
        sizes = np.diff(columns[0].offsets.to_numpy())
        start = np.cumsum(sizes) - sizes
        own = np.repeat(start, sizes).astype(np.int32)
        feature, cut, left, right, value = (c.flatten().to_numpy() for c in columns)
        return start, feature, cut, left + own, right + own, value

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score, label = self.getOrDefault(self.scoreCol), self.getPredictionCol()
        scored = self._by_broadcast(dataset, score) if self._held is not None else self._by_parts(dataset, score)
        return scored.withColumn(label, (F.col(score) > 0.5).cast("double"))

    def _by_broadcast(self, dataset: DataFrame, score: str) -> DataFrame:
        held = dataset.sparkSession.sparkContext.broadcast(flattened(self._flat()))

        @F.pandas_udf("double")
        def probability(vectors: pd.Series) -> pd.Series:
            out = np.zeros(len(vectors))
            for lo in range(0, len(out), 256):
                out[lo : lo + 256] = reached(held.value, np.stack(vectors.iloc[lo : lo + 256].to_numpy())).mean(axis=0)
            return pd.Series(out)

        return dataset.withColumn(score, probability(vector_to_array(self.getFeaturesCol())))

    def _by_parts(self, dataset: DataFrame, score: str) -> DataFrame:
        """Every block of distinct vectors meets every part of the stored trees in a task of its own."""
        dataset, spark, x = dataset.drop(score), dataset.sparkSession, vector_to_array(self.getFeaturesCol())
        sizes = self._stored.select("tree", F.size("feature").cast("long")).orderBy("tree").collect()  # a number per tree
        ends = np.cumsum([_NODE * n for _, n in sizes])
        parts = spark.createDataFrame([(t, int((end - 1) // _PART)) for (t, _), end in zip(sizes, ends)], "tree int, part int")
        last, count = int((ends[-1] - 1) // _PART), len(sizes)
        points = staged(dataset.select(x.alias("x")).distinct().withColumn("point", F.monotonically_increasing_id()), "points")
        facts = points.agg(F.count("x").alias("n"), F.max(F.size("x")).alias("f")).first()
        blocks = max(1, -(-facts["n"] * 8 * (facts["f"] or 1) // _POINTS))
        left = points.withColumn("block", F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last))))
        right = self._stored.join(F.broadcast(parts), "tree").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def add(points: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
            if points.empty or trees.empty:
                return pd.DataFrame({"point": [], "part": [], "total": []})
            trees = trees.sort_values("tree")
            flat, x = flattened(_flat(list(zip(*(trees[c] for c in _NAMES))))), points["x"].to_numpy()
            total = [reached(flat, np.stack(x[lo : lo + 256])).sum(axis=0) for lo in range(0, len(x), 256)]
            return pd.DataFrame({"point": points["point"], "part": trees["part"].iloc[0], "total": np.concatenate(total)})

        by = ["block", "part"]
        added = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(add, "point long, part int, total double")
        # added up by part, so that the sums are the same in every run
        in_order = F.array_sort(F.collect_list(F.struct("part", "total")))
        means = added.groupBy("point").agg((F.aggregate(in_order, F.lit(0.0), lambda a, r: a + r["total"]) / count).alias(score))
        scores = points.join(means, "point").select(F.col("x").alias("_forest_x"), score)
        return dataset.join(scores, x.eqNullSafe(F.col("_forest_x")), "left").select(*dataset.columns, score)
