"""Second-order gradient boosting on histograms, as a Spark ML estimator.

Features are cut into quantile bins. The rows lie as bins in the memory of the tasks of one barrier stage, so many
tasks as the table needs. For each split every task adds up gradients and hessians of its rows by (node, feature,
bin); the tasks exchange these sums and come to the same split. Of two sibling nodes the left one is counted, the
other is the parent less it. Gradients are rounded to multiples of a fixed step, so that sums are exact and the
trees do not depend on how rows are dealt. A lost task starts the stage anew.

What a task sends for a level grows with nodes, features and bins, not with rows. Every task gets the sums of all
others through the barrier's coordinator, which suits tens to a few hundred tasks; the number is bounded by ``tasks``.

Trees grow in one of three ways: ``depth`` (all nodes of a level), ``leaf`` (the best leaf first, up to
``maxLeaves``), ``level`` (one split for all nodes of a level: oblivious trees).
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasStepSize, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelrank.operators.paths import SharedPath
from labelrank.operators.saving import SavedModel

#: Cells (rows x features) of a task, and cells that are worked on at once, so that they stay in a core's cache.
CELLS, BLOCK = 1 << 26, 1 << 15
#: Cells of a table that is kept in a third layout, and rows a node up to which that one is the fastest.
ROW_CELLS, FEW_ROWS = 1 << 24, 1024
_TREES = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, value array<double>"
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    rounds: int
    depth: int
    rate: float
    grow: str
    leaves: int
    l2: float
    l1: float
    min_gain: float
    min_hessian: float
    min_rows: int
    row_share: float
    column_share: float
    seed: int

    def pull(self, g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - self.l1, 0) if self.l1 else g

    def worth(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """How much lower the loss gets with the best value for rows of these sums."""
        under = h + self.l2
        return self.pull(g) ** 2 / (under if self.l2 > 0 else np.maximum(under, 1e-300))

    def values(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """What nodes of these sums add to the score; nothing where there are no hessians at all."""
        under = h + self.l2
        return np.where(under > 0, -self.rate * self.pull(g) / np.where(under > 0, under, 1), 0.0)


def _mixed(h: np.ndarray) -> np.ndarray:
    for by in (_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)):
        h = h ^ (h >> _U(33))
        h *= by
    return h ^ (h >> _U(33))


class _Tree:
    """A tree under construction: nodes in order of birth, with their sums; feature -1 is a leaf."""

    def __init__(self, sums: np.ndarray):
        self.feature, self.bin, self.left, self.right, self.sums = [-1], [0], [-1], [-1], [sums]

    def split(self, node: int, feature: int, b: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        at = len(self.feature)
        for sums in (left, right):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.sums.append(sums)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, b, at, at + 1
        return at, at + 1


class Trainer:
    """Boosting over the rows of one task; ``add_up`` turns an array of its sums into those of all tasks."""

    def __init__(self, codes: np.ndarray, bins: int, y: np.ndarray, weight: np.ndarray, key: np.ndarray, step: float, s: Settings,
                 add_up: Callable[[np.ndarray], np.ndarray]):
        self.codes, self.bins, self.y, self.weight, self.key, self.step, self.s, self.add_up = codes, bins, y, weight, key, step, s, add_up
        self.n, self.features = codes.shape
        self.by_feature = np.ascontiguousarray(codes.T)  # the same bins again, a feature's together
        self.by_pair = self.by_row = None
        self.raw = np.zeros(self.n)

    def histogram(self, rows: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
        """(gradient, hessian, rows) x nodes x features x bins over all tasks."""
        out = np.zeros((3, nodes, self.features, self.bins))
        if not self.all_drawn:  # rows that are not drawn add nothing
            seen = np.flatnonzero(self.drawn.take(rows))
            rows, node = rows.take(seen), node.take(seen)
        if len(rows) >= 4 * nodes * self.bins**2:
            self._by_pairs(out, rows, node, nodes)
        elif self.n * self.features <= ROW_CELLS and len(rows) <= FEW_ROWS * nodes:
            self._by_rows(out, rows, node, nodes)
        else:
            self._by_features(out, rows, node, nodes)
        return self.add_up(out)

    def _by_features(self, out: np.ndarray, rows: np.ndarray, node: np.ndarray, nodes: int) -> None:
        # features that no split may use are left out but for the first, whose bins give the sums of the nodes
        wanted = np.flatnonzero(self.columns | (np.arange(self.features) == 0))
        whole, size = len(rows) == self.n, nodes * self.bins
        some = max(1, BLOCK // max(1, len(rows)))
        step = max(BLOCK, 2 * size)
        for at in range(0, len(rows), step):  # so many rows that their weights stay in the cache for all features
            r = rows[at : at + step]
            place, weights = node[at : at + step] * self.bins, [v.take(r) for v in (self.g, self.h, self.drawn)]
            for lo in range(0, len(wanted), some):
                f = wanted[lo : lo + some]
                if some == 1:
                    own = self.by_feature[f[0]]
                    cell = (own[at : at + step] if whole else own.take(r)) + place
                else:
                    cell = self.by_feature[f].take(r, axis=1) + place
                    cell += np.arange(len(f))[:, None] * size
                    cell = cell.ravel()
                for i, v in enumerate(weights):
                    if i == 2 and self.s.min_rows <= 1:  # only the sums are asked for
                        if lo == 0:
                            out[2, :, 0] += np.bincount(cell[: len(r)], v, size).reshape(nodes, self.bins)
                        continue
                    found = np.bincount(cell, v if len(f) == 1 else np.tile(v, len(f)), len(f) * size)
                    out[i][:, f] += found.reshape(len(f), nodes, self.bins).swapaxes(0, 1)

    def _by_rows(self, out: np.ndarray, rows: np.ndarray, node: np.ndarray, nodes: int) -> None:
        """The same for few rows a node: a row's bins lie together, and so do a node's rows and its sums."""
        span = self.features * self.bins
        if self.by_row is None:
            kind = np.uint16 if span <= 1 << 16 else np.int32
            self.by_row = self.codes.astype(kind) + (np.arange(self.features) * self.bins).astype(kind)
        order = np.argsort(node.astype(np.uint16) if nodes <= 1 << 16 else node, kind="stable")
        rows, node = rows[order], node[order]
        some, weights, flat = max(1, BLOCK // self.features), [v[rows] for v in (self.g, self.h, self.drawn)], out.reshape(3, -1)
        for at in range(0, len(rows), some):
            own, weight = node[at : at + some], [v[at : at + some] for v in weights]
            first, size = own[0] * span, (own[-1] - own[0] + 1) * span
            cell = np.add(self.by_row[rows[at : at + some]], (own * span - first)[:, None], dtype=np.intp).ravel()
            for i in range(3 if self.s.min_rows > 1 else 2):
                flat[i, first : first + size] += np.bincount(cell, np.repeat(weight[i], self.features), size)
        if self.s.min_rows <= 1:  # only the sums are asked for
            out[2, :, 0] = np.bincount(node * self.bins + self.codes[rows, 0], weights[2], nodes * self.bins).reshape(nodes, self.bins)

    def _by_pairs(self, out: np.ndarray, rows: np.ndarray, node: np.ndarray, nodes: int) -> None:
        """The same for many rows a node: two features are counted at once, by their pairs of bins, and told apart after."""
        if self.by_pair is None:
            odd = self.by_feature[1::2]
            self.by_pair = self.by_feature[0::2].astype(np.uint16) * np.uint16(self.bins)
            self.by_pair[: len(odd)] += odd
        whole, size = len(rows) == self.n, nodes * self.bins**2
        step = max(BLOCK, 4 * size)
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            place, weights = node[at : at + step] * self.bins**2, [v.take(r) for v in (self.g, self.h, self.drawn)]
            for j, own in enumerate(self.by_pair):
                if j and not self.columns[2 * j : 2 * j + 2].any():
                    continue
                cell = (own[at : at + step] if whole else own.take(r)) + place
                for i, v in enumerate(weights):
                    if i == 2 and self.s.min_rows <= 1 and j:
                        continue
                    found = np.bincount(cell, v, size).reshape(nodes, self.bins, self.bins)
                    out[i, :, 2 * j] += found.sum(axis=2)
                    if 2 * j + 1 < self.features:
                        out[i, :, 2 * j + 1] += found.sum(axis=1)

    def gains(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """nodes x features x bins: what a split behind each bin gains, and where it is not allowed."""
        s = self.s
        left = found[:2].cumsum(axis=3)
        whole = left[..., -1:]
        right = whole - left
        gain = s.worth(*left)
        gain += s.worth(*right)
        gain -= s.worth(*whole)
        gain *= 0.5
        # a child without drawn rows has no hessians either
        bad = np.minimum(left[1], right[1]) < max(s.min_hessian, 1 / self.step)
        if s.min_rows > 1:
            rows = found[2].cumsum(axis=2)
            bad |= np.minimum(rows, rows[..., -1:] - rows) < s.min_rows
        bad |= ~self.columns[None, :, None]
        return gain, bad

    def round(self, number: int) -> tuple[_Tree, np.ndarray]:
        """The next tree, and the leaf of every row."""
        s = self.s
        p = 1 / (1 + np.exp(-self.raw))
        salt = _mixed(np.array([s.seed * 1_000_003 + number], np.uint64))[0]
        self.drawn = (_mixed(self.key ^ salt) >> _U(11)).astype(np.float64) / 2**53 < s.row_share
        self.all_drawn = bool(self.drawn.all())
        self.drawn = self.drawn.astype(np.float64)
        self.g = np.rint((p - self.y) * self.weight * self.step) / self.step * self.drawn
        self.h = np.rint(p * (1 - p) * self.weight * self.step) / self.step * self.drawn
        rng = np.random.default_rng([s.seed, number])
        self.columns = np.zeros(self.features, bool)
        self.columns[rng.permutation(self.features)[: max(1, round(s.column_share * self.features))]] = True
        rows = np.arange(self.n)
        root = self.histogram(rows, np.zeros(self.n, np.int64), 1)
        tree = _Tree(root[:, 0, 0].sum(axis=1))
        leaf = (self._best_leaf if s.grow == "leaf" else self._by_level)(tree, root)
        sums = np.array(tree.sums)
        values = s.values(sums[:, 0], sums[:, 1])
        self.raw += values[leaf]
        tree.values = values
        return tree, leaf

    def _best_splits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per node the best split (feature x bins + bin) and its gain; one for all nodes if they split alike."""
        nodes, some = found.shape[1], max(1, BLOCK // (self.features * self.bins))
        parts = (self.gains(found[:, lo : lo + some]) for lo in range(0, nodes, some))
        if self.s.grow == "level":
            total, never = np.zeros(found.shape[2:]), np.ones(found.shape[2:], bool)
            for gain, bad in parts:
                gain[bad] = 0
                for one in gain:
                    total += one
                never &= bad.all(axis=0)
            total[never] = -np.inf
            return np.full(nodes, total.argmax()), np.full(nodes, total.max())
        best, most = [], []
        for gain, bad in parts:
            gain[bad] = -np.inf
            flat = gain.reshape(len(gain), -1)
            best.append(flat.argmax(axis=1))
            most.append(flat.max(axis=1))
        return np.concatenate(best), np.concatenate(most)

    def _siblings(self, found: np.ndarray, feature: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Nodes whose right child is to be counted, the one of fewer hessians; the sums are exact, so either way gives the same ones."""
        left = self._below(found, feature, b)
        return 2 * left > found[1, :, 0].sum(axis=1)

    @staticmethod
    def _below(found: np.ndarray, feature: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hessians on the left side of each node's split."""
        own = found[1, np.arange(len(feature)), feature]
        return np.where(np.arange(own.shape[1]) <= b[:, None], own, 0).sum(axis=1)

    def _right(self, rows: np.ndarray, at: np.ndarray, feature: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows on the right side of the splits of their nodes."""
        if (feature == feature[0]).all() and (b == b[0]).all():
            own = self.by_feature[feature[0]]
            return (own if len(rows) == self.n else own.take(rows)) > b[0]
        return self.codes.reshape(-1).take(rows * self.features + feature.take(at)) > b.take(at)

    def _by_level(self, tree: _Tree, found: np.ndarray) -> np.ndarray:
        s = self.s
        leaf = np.zeros(self.n, np.int64)
        rows = np.arange(self.n)  # those in open nodes
        at = np.zeros(self.n, np.int64)  # their nodes among the open ones
        opened = np.array([0])

        def closed(good: np.ndarray, opened: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows of the nodes that stay open, and their new places; the others are in a leaf."""
            stays = good.take(at)
            left = np.flatnonzero(~stays)
            leaf[rows.take(left)] = opened.take(at.take(left))
            left = np.flatnonzero(stays)
            return rows.take(left), (np.cumsum(good) - 1).take(at.take(left))

        for level in range(s.depth):
            best, most = self._best_splits(found)
            good = most > s.min_gain + 1e-12
            if not good.any():
                break
            feature, b = np.divmod(best, self.bins)
            if not good.all():
                rows, at = closed(good, opened, rows, at)
                opened, feature, b, found = opened[good], feature[good], b[good], found[:, good]
            right = self._right(rows, at, feature, b)
            child = 2 * at + right
            if level + 1 < s.depth:
                other = self._siblings(found, feature, b)
                seen = np.flatnonzero(right == (other.take(at) if other.any() else False))
                counted = self.histogram(rows.take(seen), at.take(seen), len(opened))
                rest = found - counted
                swap = other[None, :, None, None]
                under, above = (np.where(swap, rest, counted), np.where(swap, counted, rest)) if other.any() else (counted, rest)
                sums = np.stack([under[:, :, 0].sum(axis=2), above[:, :, 0].sum(axis=2)], axis=2).reshape(3, -1)
            else:  # the last level splits no more, so its sums are enough
                sums = self.add_up(np.array([np.bincount(child, v.take(rows), 2 * len(opened)) for v in (self.g, self.h, self.drawn)]))
            born = np.array([
                tree.split(int(v), int(feature[k]), int(b[k]), sums[:, 2 * k], sums[:, 2 * k + 1]) for k, v in enumerate(opened)]).reshape(-1)
            opened, at = born, child
            if level + 1 == s.depth:
                break
            found = np.stack([under, above], axis=2).reshape(3, -1, *under.shape[2:])
            held = sums[2] > 0  # nodes without drawn rows stay as they are
            if not held.all():
                rows, at = closed(held, opened, rows, at)
                opened, found = opened[held], found[:, held]
        leaf[rows] = opened.take(at)
        return leaf

    def _best_leaf(self, tree: _Tree, found: np.ndarray) -> np.ndarray:
        s = self.s
        leaf = np.zeros(self.n, np.int64)
        todo: list = []

        def offer(node: int, depth: int, own: np.ndarray, rows: np.ndarray) -> None:
            if depth < s.depth:
                gain, bad = (a[0] for a in self.gains(own))
                gain[bad] = -np.inf
                best = int(np.argmax(gain))
                if gain.flat[best] > s.min_gain + 1e-12:
                    heapq.heappush(todo, (-gain.flat[best], node, best, depth, own, rows))

        offer(0, 0, found, np.arange(self.n))
        leaves = 1
        while todo and leaves < s.leaves:
            _, node, best, depth, own, rows = heapq.heappop(todo)
            feature, b = divmod(best, self.bins)
            codes = self.by_feature[feature]
            right = (codes if len(rows) == self.n else codes.take(rows)) > b
            sides = [rows.take(np.flatnonzero(~right)), rows.take(np.flatnonzero(right))]
            counted = sides[int(self._siblings(own, np.array([feature]), np.array([b]))[0])]
            first = self.histogram(counted, np.zeros(len(counted), np.int64), 1)
            under, above = (first, own - first) if counted is sides[0] else (own - first, first)
            a, c = tree.split(node, feature, b, under[:, 0, 0].sum(axis=1), above[:, 0, 0].sum(axis=1))
            leaf[sides[0]], leaf[sides[1]] = a, c
            leaves += 1
            offer(a, depth + 1, under, sides[0])
            offer(c, depth + 1, above, sides[1])
        return leaf


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Rows x features: the number of edges below each value; NaN lies behind all."""
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def _quantiles(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """The inner edges of so many quantile bins, for each place of the vectors ``x``.

    The shares are a text until the plan is optimized: as literals of their own, once for each place, they were most of it.
    """
    shares = f"cast(split('{','.join(repr(k / bins) for k in range(1, bins))}', ',') as array<double>)"
    cuts = rows.selectExpr(*[f"percentile_approx(case when not isnan(x[{j}]) then x[{j}] end, {shares}, 100000) as e{j}" for j in range(width)]).first()
    return [np.unique(np.array(e if e is not None else [], np.float64)) for e in cuts]


class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasWeightCol, HasMaxIter, HasStepSize, HasSeed):
    maxDepth = Param(Params._dummy(), "maxDepth", "deepest level of a tree", TypeConverters.toInt)
    grow = Param(Params._dummy(), "grow", "depth, leaf or level", TypeConverters.toString)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree that grows by leaf", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "added to a node's hessians", TypeConverters.toFloat)
    l1 = Param(Params._dummy(), "l1", "taken from the size of a node's gradients", TypeConverters.toFloat)
    minGain = Param(Params._dummy(), "minGain", "a split gains more than this", TypeConverters.toFloat)
    minHessian = Param(Params._dummy(), "minHessian", "hessians of a child at least", TypeConverters.toFloat)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "drawn rows of a child at least", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows drawn for a tree", TypeConverters.toFloat)
    columnRate = Param(Params._dummy(), "columnRate", "share of features drawn for a tree", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "quantile bins of a feature, 255 at most", TypeConverters.toInt)
    tasks = Param(Params._dummy(), "tasks", "tasks that hold the rows: 0 for as many as they need, and never more than there are cores", TypeConverters.toInt)
    scoreCol = Param(Params._dummy(), "scoreCol", "probability of label 1", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(
            maxIter=100, stepSize=0.1, seed=42, maxDepth=6, grow="depth", maxLeaves=31, l2=1.0, l1=0.0, minGain=0.0, minHessian=0.0,
            minInstancesPerNode=1, subsamplingRate=1.0, columnRate=1.0, maxBins=32, tasks=0, scoreCol="score")

    def getMinInstancesPerNode(self) -> int:
        return self.getOrDefault(self.minInstancesPerNode)

    def settings(self) -> Settings:
        o = self.getOrDefault
        if o("grow") not in ("depth", "leaf", "level"):
            raise ValueError("grow is depth, leaf or level")
        return Settings(
            o("maxIter"), o("maxDepth"), o("stepSize"), o("grow"), o("maxLeaves"), o("l2"), o("l1"), o("minGain"), o("minHessian"),
            o("minInstancesPerNode"), o("subsamplingRate"), o("columnRate"), o("seed") % 2**31)


class HistogramBoosting(SharedPath, Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on rows whose label is 0 or 1 (rows with a null label do not count); there must be one at least."""

    _length = "maxIter"

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None, maxIter=100, stepSize=0.1,
                 seed=42, maxDepth=6, grow="depth", maxLeaves=31, l2=1.0, l1=0.0, minGain=0.0, minHessian=0.0, minInstancesPerNode=1,
                 subsamplingRate=1.0, columnRate=1.0, maxBins=32, tasks=0, scoreCol="score"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit_path(self, dataset: DataFrame, lengths: Sequence[int]) -> list[HistogramBoostingModel]:
        longest = self.copy({self.maxIter: max(lengths)})._fit(dataset)
        return [HistogramBoostingModel(longest.trees.slice(0, n)) for n in lengths]

    def _fit(self, dataset: DataFrame) -> HistogramBoostingModel:
        s, spark = self.settings(), dataset.sparkSession
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined(self.weightCol) else F.lit(1.0)
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), weight.alias("w")).where("y is not null")
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.max("w").alias("most"), F.max(F.size("x")).alias("f"), F.min(F.size("x")).alias("g")).first()
        if not facts["n"] or facts["f"] != facts["g"]:
            raise ValueError("there must be rows with a label, and vectors of one width")
        n, width, bins = facts["n"], facts["f"], min(255, self.getOrDefault(self.maxBins))
        edges = _quantiles(rows, width, bins)
        # a sum over all rows stays below 2**52 steps, so it is exact in any order
        step = 2.0 ** (51 - math.ceil(math.log2(max(float(facts["w"]), float(n) * 2**-20, 1e-9) + 1)))
        needed = self.getOrDefault(self.tasks) or -(-n * width // CELLS)
        tasks = max(1, min(needed, spark.sparkContext.defaultParallelism))
        held = spark.sparkContext.broadcast(edges)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context = BarrierTaskContext.get()
            many = len(context.getTaskInfos())

            def add_up(own: np.ndarray) -> np.ndarray:
                if many == 1:
                    return own
                parts = context.allGather(base64.b64encode(own.tobytes()).decode())
                return sum(np.frombuffer(base64.b64decode(p)) for p in parts).reshape(own.shape)

            codes, ys, ws, keys = [np.zeros((0, width), np.uint8)], [np.zeros(0)], [np.zeros(0)], [np.zeros(0, np.uint64)]
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                codes.append(_binned(x, held.value))
                ys.append(batch.column(1).to_numpy(zero_copy_only=False))
                ws.append(batch.column(2).to_numpy(zero_copy_only=False))
                keys.append(batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))
            trainer = Trainer(*map(np.concatenate, (codes,)), bins + 1, *map(np.concatenate, (ys, ws, keys)), step, s, add_up)
            for t in range(s.rounds):
                tree, _ = trainer.round(t)
                if context.partitionId() == 0:
                    cut = [float(held.value[f][b]) if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin)]
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([t], pa.int32()), "feature": pa.array([tree.feature], pa.list_(pa.int32())), "cut": pa.array([cut], pa.list_(pa.float64())),
                        "left": pa.array([tree.left], pa.list_(pa.int32())), "right": pa.array([tree.right], pa.list_(pa.int32())),
                        "value": pa.array([tree.values.tolist()], pa.list_(pa.float64()))})

        # the key of a row is its content, so that copies are drawn together wherever they lie
        dealt = rows.select("x", "y", "w", F.xxhash64("x", "y", "w").alias("key")).repartition(tasks)
        trees = dealt.mapInArrow(run, _TREES, barrier=True).toArrow().sort_by("tree")
        return self._copyValues(HistogramBoostingModel(trees))


def flattened(trees: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(roots, feature, cut, both sides of each node, right and left by turns, value) of trees laid together, for ``reached``."""
    root, feature, cut, left, right, value = trees
    return root, feature, cut, np.stack([right, left], axis=1).ravel(), value


def reached(flat: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Trees x rows: the value of the leaf that each row reaches in each tree. A missing value goes to the right."""
    root, feature, cut, sides, value = flat
    n, cells = len(x), np.ascontiguousarray(x).ravel()
    node, first, moving = np.repeat(root, n), np.tile(np.arange(n) * x.shape[1], len(root)), None
    at = node
    while True:
        f = feature.take(node)
        inner = np.flatnonzero(f >= 0)
        if len(inner) < len(node):
            moving = inner if moving is None else moving.take(inner)
            node, f, first = node.take(inner), f.take(inner), first.take(inner)
        if not len(node):
            return value.take(at).reshape(len(root), n)
        node = sides.take(2 * node + (cells.take(first + f) <= cut.take(node)))
        if moving is None:
            at = node
        else:
            at[moving] = node


class HistogramBoostingModel(Model, _BoostParams, SavedModel):
    """All trees as arrays, which rows go down together, a level at a time."""

    def __init__(self, trees: pa.Table):
        super().__init__()
        self.trees = trees

    @property
    def rounds(self) -> int:
        return self.trees.num_rows

    def _save_parts(self, path: str) -> None:
        SparkSession.active().createDataFrame(self.trees).coalesce(1).write.parquet(f"{path}/trees")

    @classmethod
    def _restore(cls, fitted: dict, path: str, spark) -> HistogramBoostingModel:
        return cls(spark.read.schema(_TREES).parquet(f"{path}/trees").toArrow().sort_by("tree"))

    def _flat(self) -> tuple[np.ndarray, ...]:
        start = np.concatenate([[0], np.cumsum([len(f) for f in self.trees["feature"].to_pylist()])]).astype(np.int64)
        own = np.repeat(start[:-1], np.diff(start))
        feature, cut, left, right, value = (
            self.trees[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) if self.rounds else np.zeros(0) for c in ("feature", "cut", "left", "right", "value"))
        return start[:-1], feature.astype(np.int64), cut, left.astype(np.int64) + own, right.astype(np.int64) + own, value

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = dataset.sparkSession.sparkContext.broadcast(flattened(self._flat()))

        @F.pandas_udf("double")
        def probability(vectors):
            out = np.zeros(len(vectors))
            for lo in range(0, len(out), 256):
                out[lo : lo + 256] = reached(held.value, np.stack(vectors.iloc[lo : lo + 256].to_numpy())).sum(axis=0)
            import pandas as pd

            return pd.Series(1 / (1 + np.exp(-out)))

        score, label = self.getOrDefault(self.scoreCol), self.getPredictionCol()
        scored = dataset.withColumn(score, probability(vector_to_array(self.getFeaturesCol())))
        return scored.withColumn(label, (F.col(score) > 0.5).cast("double"))
