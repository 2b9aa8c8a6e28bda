"""Boosted trees against splits and sums by hand."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labelrank.operators import boosting
from labelrank.operators.boosting import HistogramBoosting, HistogramBoostingModel, Settings, Trainer
from labelrank.sources.tables import load_model, save_model

FEATURES = 6


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(300, FEATURES)), 1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.3, size=300)) > 0.4).astype(float)
    return x, y, np.where(y == 1, 1.5, 1.0)


@pytest.fixture(scope="module")
def table(spark, data):
    x, y, w = data
    rows = [(i, [float(v) for v in a], float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "row_key int, x array<double>, label double, weight double").withColumn("features", array_to_vector("x")).drop("x").repartition(5)


def worth(g, h, l1, l2):
    return (np.sign(g) * max(abs(g) - l1, 0)) ** 2 / (h + l2) if h + l2 > 0 else 0.0


def best_by_hand(x, g, h, rows, l1, l2, min_hessian=0.0, min_rows=1):
    """(gain, feature, cut) over all cuts between the values of the rows."""
    best = (-np.inf, None, None)
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            under = rows & (x[:, f] <= c)
            above = rows & ~under
            if min(under.sum(), above.sum()) < min_rows or min(h[under].sum(), h[above].sum()) < min_hessian:
                continue
            gain = 0.5 * (worth(g[under].sum(), h[under].sum(), l1, l2) + worth(g[above].sum(), h[above].sum(), l1, l2) - worth(g[rows].sum(), h[rows].sum(), l1, l2))
            if gain > best[0] + 1e-9:
                best = (gain, f, c)
    return best


def first_tree(model):
    return {k: v[0] for k, v in model.trees.to_pydict().items()}


@pytest.mark.parametrize("tasks", [1, 3])
def test_one_split_equals_hand(table, data, tasks):
    x, y, w = data
    model = HistogramBoosting(maxIter=1, maxDepth=1, l1=0.5, l2=1.5, stepSize=0.1, weightCol="weight", maxBins=255, tasks=tasks).fit(table)
    g, h = (0.5 - y) * w, 0.25 * w
    _, f, c = best_by_hand(x, g, h, np.ones(300, bool), 0.5, 1.5)
    tree = first_tree(model)
    assert tree["feature"] == [f, -1, -1] and tree["cut"][0] == c
    for node, rows in ((1, x[:, f] <= c), (2, x[:, f] > c)):
        G, H = g[rows].sum(), h[rows].sum()
        assert tree["value"][node] == pytest.approx(-0.1 * np.sign(G) * max(abs(G) - 0.5, 0) / (H + 1.5), abs=1e-9)


def test_best_leaf_first(table, data):
    x, y, _ = data
    model = HistogramBoosting(maxIter=1, grow="leaf", maxLeaves=4, maxDepth=10, l2=0.0, minInstancesPerNode=20, maxBins=255).fit(table)
    g, h = 0.5 - y, np.full(300, 0.25)
    leaves, order = {0: np.ones(300, bool)}, []
    for born in (1, 3, 5):
        offers = {k: best_by_hand(x, g, h, r, 0.0, 0.0, 0.0, 20) for k, r in leaves.items()}
        k = max(offers, key=lambda k: offers[k][0])
        _, f, c = offers[k]
        order.append((k, f, c))
        rows = leaves.pop(k)
        leaves[born], leaves[born + 1] = rows & (x[:, f] <= c), rows & (x[:, f] > c)
    tree = first_tree(model)
    assert [(k, tree["feature"][k], tree["cut"][k]) for k, _, _ in order] == order and sum(f >= 0 for f in tree["feature"]) == 3
    assert [tree["left"][k] for k, _, _ in order] == [1, 3, 5]


def test_oblivious_levels_share_a_split(table, data):
    x, y, _ = data
    model = HistogramBoosting(maxIter=1, grow="level", maxDepth=3, l2=5.0, maxBins=255).fit(table)
    tree = first_tree(model)
    g, h = 0.5 - y, np.full(300, 0.25)
    groups, node_groups = [np.ones(300, bool)], [[0]]
    for level in range(3):
        best = (-np.inf, None, None)
        for f in range(FEATURES):
            for c in np.unique(x[:, f])[:-1]:
                total = 0.0
                for r in groups:
                    a, b = r & (x[:, f] <= c), r & (x[:, f] > c)
                    if a.sum() and b.sum():
                        total += 0.5 * (worth(g[a].sum(), h[a].sum(), 0, 5) + worth(g[b].sum(), h[b].sum(), 0, 5) - worth(g[r].sum(), h[r].sum(), 0, 5))
                if total > best[0] + 1e-9:
                    best = (total, f, c)
        _, f, c = best
        assert {(tree["feature"][k], tree["cut"][k]) for k in node_groups[-1] if tree["feature"][k] >= 0} == {(f, c)}
        node_groups.append([n for k in node_groups[-1] if tree["feature"][k] >= 0 for n in (tree["left"][k], tree["right"][k])])
        groups = [p for r in groups for p in (r & (x[:, f] <= c), r & (x[:, f] > c)) if p.any()]


@pytest.mark.parametrize("grow", ["depth", "leaf", "level"])
def test_trees_do_not_depend_on_tasks(table, grow):
    make = lambda tasks: HistogramBoosting(maxIter=8, grow=grow, maxDepth=4, subsamplingRate=0.8, columnRate=0.7, weightCol="weight", tasks=tasks, minGain=0.01)
    one, three = make(1).fit(table), make(3).fit(table.repartition(2))
    assert one.trees.equals(three.trees) and one.rounds == 8


def test_learns_scores_and_is_saved(spark, table, tmp_path):
    model = HistogramBoosting(maxIter=60, maxDepth=4, weightCol="weight").fit(table)
    out = model.transform(table).select("row_key", "label", "score", "prediction").orderBy("row_key").collect()
    assert all(0 <= r["score"] <= 1 for r in out) and np.mean([r["label"] == r["prediction"] for r in out]) > 0.97
    save_model(PipelineModel([model]), str(tmp_path), "m")
    again = load_model(str(tmp_path), "m").transform(table).select("row_key", "label", "score", "prediction").orderBy("row_key").collect()
    assert again == out


def test_sampled_rows_and_sibling_sums(data):
    x, y, w = data
    codes = np.stack([np.searchsorted(np.unique(x[:, j])[:-1], x[:, j], "left") for j in range(FEATURES)], axis=1).astype(np.uint8)
    s = Settings(1, 5, 0.1, "depth", 31, 1.0, 0.0, 0.0, 0.0, 1, 0.6, 1.0, 1)
    trainer = Trainer(codes, 256, y, w, np.arange(300, dtype=np.uint64), 2.0**30, s, lambda a: a)
    tree, leaf = trainer.round(0)
    assert 120 < trainer.drawn.sum() < 240
    for k in np.unique(leaf):
        rows = leaf == k
        assert tree.sums[k].tolist() == [trainer.g[rows].sum(), trainer.h[rows].sum(), trainer.drawn[rows].sum()]


def test_edge_tables(spark):
    rows = [(1.0, [1.0, float("nan")]), (1.0, [2.0, 3.0]), (None, [5.0, 5.0])]
    table = spark.createDataFrame(rows, "label double, x array<double>").withColumn("features", array_to_vector("x"))
    model = HistogramBoosting(maxIter=3).fit(table)
    assert [r["prediction"] for r in model.transform(table).collect()] == [1.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        HistogramBoosting().fit(table.limit(0))
    assert model.transform(table.limit(0)).count() == 0 and isinstance(model, HistogramBoostingModel)


def test_histograms_leave_out_what_no_split_uses(monkeypatch):
    """Rows that are not drawn, features that are not drawn, and row counts nobody asks for cost nothing; block by block."""
    from labelrank.operators import boosting

    rng = np.random.default_rng(6)
    n, features, bins = 5000, 10, 8
    codes, g, h = rng.integers(0, bins, (n, features)).astype(np.uint8), rng.integers(-9, 9, n).astype(float), rng.integers(0, 9, n).astype(float)
    s = boosting.Settings(1, 3, 0.1, "depth", 31, 1.0, 0.0, 0.0, 0.0, 1, 0.5, 0.3, 7)
    t = boosting.Trainer(codes, bins, np.zeros(n), np.ones(n), np.arange(n).astype(np.uint64), 1.0, s, lambda a: a)
    t.drawn, t.all_drawn, t.columns = (np.arange(n) % 2).astype(float), False, np.arange(features) >= 7
    t.g, t.h = g * t.drawn, h * t.drawn
    node = rng.integers(0, 4, n)
    want = np.zeros((3, 4, features, bins))
    for i, v in enumerate((t.g, t.h, t.drawn)):
        for f in range(features):
            np.add.at(want[i, :, f], (node, codes[:, f]), v)
    cells, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a: cells.append(len(x)) or plain(x, *a))
    for block in (1 << 15, 700):
        monkeypatch.setattr(boosting, "BLOCK", block)
        cells.clear()
        found = t.histogram(np.arange(n), node, 4)
        assert (found[:2][:, :, t.columns] == want[:2][:, :, t.columns]).all() and (found[:, :, 0] == want[:, :, 0]).all()
        assert sum(cells) <= 7 * n / 2  # two at once
        cells.clear()
        found = np.zeros_like(want)
        seen = np.flatnonzero(t.drawn)
        t._by_features(found, seen, node[seen], 4)
        assert (found[:2][:, :, t.columns] == want[:2][:, :, t.columns]).all() and (found[:, :, 0] == want[:, :, 0]).all()
        assert sum(cells) <= 9 * n / 2


@pytest.mark.parametrize("min_rows", [1, 5])
def test_rows_laid_together_give_the_same_sums(monkeypatch, min_rows):
    """With few rows a node, a row's bins are read together; sums and trees stay those of bins by feature."""
    rng = np.random.default_rng(2)
    codes, y = rng.integers(0, 33, (3000, 7)).astype(np.uint8), rng.integers(0, 2, 3000).astype(float)
    key = rng.integers(0, 2**63, 3000).astype(np.uint64)
    s = Settings(3, 6, 0.3, "depth", 31, 1.0, 0.0, 0.0, 0.0, min_rows, 0.8, 0.7, 4)
    real, taken = Trainer._by_rows, []
    monkeypatch.setattr(Trainer, "_by_rows", lambda self, *a: taken.append(1) or real(self, *a))

    def trees():
        trainer = Trainer(codes, 33, y, np.ones(3000), key, 2.0**30, s, lambda a: a)
        return [(t.feature, t.bin, t.left, t.values.tolist(), leaf.tolist()) for t, leaf in map(trainer.round, range(3))]

    by_rows = trees()
    assert len(taken) >= 10
    monkeypatch.setattr(boosting, "FEW_ROWS", 0)
    taken.clear()
    assert trees() == by_rows and not taken and len(by_rows[0][0]) > 30


@pytest.mark.parametrize("grow", ["depth", "level", "leaf"])
def test_of_two_siblings_the_smaller_is_counted(monkeypatch, grow):
    """Most rows lie on the left of every split; leaves, sums and scores are those of the rows."""
    rng = np.random.default_rng(8)
    codes = (33 * rng.random((4000, 5)) ** 0.2).astype(np.uint8)
    codes[:, :2] = 32 - codes[:, :2]
    y = (rng.random(4000) < np.where((codes[:, 0] > 8) | (codes[:, 1] > 12), 0.9, 0.1)).astype(float)
    s = Settings(1, 4, 0.3, grow, 8, 1.0, 0.0, 0.0, 0.0, 1, 1.0, 1.0, 4)
    real, counted = Trainer.histogram, []
    monkeypatch.setattr(Trainer, "histogram", lambda self, rows, *a: counted.append(len(rows)) or real(self, rows, *a))
    trainer = Trainer(codes, 33, y, np.ones(4000), np.arange(4000, dtype=np.uint64), 2.0**30, s, lambda a: a)
    tree, leaf = trainer.round(0)
    assert counted[0] == 4000 and counted[1] < 2000 and sum(counted[1:]) <= 2000 * (len(counted) - 1)
    right = codes[:, tree.feature[0]] > tree.bin[0]
    assert counted[1] == min(right.sum(), (~right).sum()) and right.sum() < 2000
    at = np.zeros(4000, int)
    while (inner := np.array(tree.feature)[at] >= 0).any():
        under = codes[np.arange(4000), np.array(tree.feature)[at]] <= np.array(tree.bin)[at]
        at = np.where(inner, np.where(under, np.array(tree.left)[at], np.array(tree.right)[at]), at)
    assert (at == leaf).all()
    for k in np.unique(leaf):
        assert tree.sums[k].tolist() == [trainer.g[leaf == k].sum(), trainer.h[leaf == k].sum(), (leaf == k).sum()]


def test_bins_come_from_a_short_plan(spark):
    from labelrank.operators.boosting import _quantiles

    values = [float(v) for v in range(1, 101)]
    rows = spark.createDataFrame([([v, -v, float("nan") if v > 50 else v],) for v in values], "x array<double>")
    edges = _quantiles(rows, 3, 4)
    assert [e.tolist() for e in edges] == [[25.0, 50.0, 75.0], [-76.0, -51.0, -26.0], [13.0, 25.0, 38.0]]
