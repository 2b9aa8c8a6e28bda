"""Forests against trees grown by hand; both ways of growing give the same trees."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labelrank.operators import forest
from labelrank.operators.forest import HistogramForest, HistogramForestModel, Settings, _draw, grow
from labelrank.sources.tables import load_model, save_model

FEATURES = 5


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, FEATURES)), 1)
    x[:, 4] = 1.0
    x[:150] = x[0]  # more than a third are copies
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=400)) > 0.3).astype(float)
    return x, y


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(*data))]
    return spark.createDataFrame(rows, "row_key int, x array<double>, label double").withColumn("features", array_to_vector("x")).drop("x").repartition(4)


def gini(y):
    return len(y) - (y.sum() ** 2 + (1 - y).sum() ** 2) / len(y) if len(y) else 0.0


def by_hand(x, y, min_split, min_rows):
    """(score of each row, decrease by feature) of one tree over all rows and features; -1 scores where cuts tie."""
    score, gain = np.zeros(len(y)), np.zeros(x.shape[1])

    def down(rows):
        score[rows] = y[rows].mean()
        if len(rows) < min_split or y[rows].min() == y[rows].max():
            return
        found = []
        for f in range(x.shape[1]):
            for c in np.unique(x[rows, f])[:-1]:
                under = x[rows, f] <= c
                if min(under.sum(), (~under).sum()) >= min_rows:
                    found.append((gini(y[rows]) - gini(y[rows][under]) - gini(y[rows][~under]), f, c))
        if not found:
            return
        best = max(found)[0]
        ties = {tuple(x[rows, f] <= c) for g, f, c in found if g > best - 1e-9}
        if len(ties) > 1:
            score[rows] = -1
            return
        _, f, c = max(found)
        gain[f] += best
        down(rows[x[rows, f] <= c])
        down(rows[x[rows, f] > c])

    down(np.arange(len(y)))
    return score, gain


@pytest.mark.parametrize("small, min_split, min_rows", [(1 << 25, 2, 1), (1 << 25, 10, 3), (0, 10, 3), (0, 2, 1)])
def test_one_tree_equals_hand(table, data, small, min_split, min_rows):
    x, y = data
    model = HistogramForest(numTrees=1, subset="all", bootstrap=False, minSplit=min_split, minInstancesPerNode=min_rows, smallBytes=small, nodeRows=60).fit(table)
    got = {r.row_key: r.score for r in model.transform(table).collect()}
    want, _ = by_hand(x, y, min_split, min_rows)
    known = want >= 0
    assert known.sum() > 150
    assert np.allclose(np.array([got[i] for i in range(len(y))])[known], want[known])


def test_pure_leaves_without_a_depth_limit(spark):
    rows = [(i, [float(i)], float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_key int, x array<double>, label double").withColumn("features", array_to_vector("x"))
    model = HistogramForest(numTrees=1, bootstrap=False).fit(df)
    assert model.transform(df).where("score != label").count() == 0
    assert HistogramForest(numTrees=1, bootstrap=False, maxDepth=3).fit(df).trees["feature"][0].as_py().count(0) <= 7


@pytest.mark.parametrize("batch, depth", [(3, 0), (20, 4)])
def test_queue_and_broadcast_grow_the_same_trees(table, batch, depth):
    kw = dict(numTrees=7, maxDepth=depth, minSplit=4, seed=5)
    whole, queued = HistogramForest(**kw), HistogramForest(**kw, smallBytes=0, nodeRows=40, treeBatch=batch)
    a, b = ({r.row_key: r.score for r in f.fit(table).transform(table).collect()} for f in (whole, queued))
    assert a == pytest.approx(b, abs=1e-12)
    assert whole.importances(table) == pytest.approx(queued.importances(table.repartition(7)), abs=1e-12)


def test_importances(table, data):
    found = HistogramForest(numTrees=1, subset="all", bootstrap=False, maxDepth=1).importances(table)
    x, y = data
    best = max((gini(y) - gini(y[x[:, f] <= c]) - gini(y[x[:, f] > c]), f) for f in range(FEATURES) for c in np.unique(x[:, f])[:-1])
    assert found == [float(f == best[1]) for f in range(FEATURES)]
    found = HistogramForest(numTrees=30).importances(table)
    assert sum(found) == pytest.approx(1) and found[4] == 0 and min(found[:4]) > 0


def test_draws_have_the_mean_and_variance_of_copies():
    rng = np.random.default_rng(0)
    key = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    for copies in (1, 5, 40):
        got = _draw(key, np.full(len(key), copies), 77, 1)
        assert abs(got.mean() - copies) < 0.05 * copies and abs(got.var() - copies) < 0.1 * copies
    assert (_draw(key[::-1].copy(), np.full(len(key), 5), 77, 1)[::-1] == _draw(key, np.full(len(key), 5), 77, 1)).all()


def test_constant_features_are_passed_over():
    """A node that first looks at features without a cut goes on to the others."""
    codes = np.zeros((50, 30), np.uint8)
    codes[:, 17] = np.arange(50) % 2
    w1 = (np.arange(50) % 2).astype(np.int64)
    for key in range(1, 20):
        feature, *_, importance = grow(codes, 1 - w1, w1, key, 0, Settings(1, 0, 2, 1, 5, True, 1))
        assert feature.tolist() == [17, -1, -1] and importance[17] == 25


def test_one_class_few_rows_and_bad_input(spark, table):
    one = table.where("label = 1").limit(3)
    model = HistogramForest(numTrees=3).fit(one)
    assert {r.score for r in model.transform(table).select("score").distinct().collect()} == {1.0}
    assert HistogramForest(numTrees=3).importances(one) == [0.0] * FEATURES
    for bad in (table.limit(0), table.selectExpr("row_key", "label + 1 as label", "features")):
        with pytest.raises(ValueError):
            HistogramForest().fit(bad)
    with pytest.raises(ValueError, match="minSplit"):
        HistogramForest(numTrees=3, modelBytes=100).fit(table)


def test_saved_and_loaded(spark, table, tmp_path):
    model = HistogramForest(numTrees=4).fit(table)
    save_model(PipelineModel([model]), str(tmp_path), "forest")
    back = load_model(str(tmp_path), "forest")
    a, b = ({r.row_key: r.score for r in m.transform(table).collect()} for m in (model, back))
    assert a == b


def test_weights_travel_with_the_cells(monkeypatch):
    """A tree reads each weight in the order of its rows only: light ones are sorted along, the tree stays that of heavy ones."""
    rng = np.random.default_rng(4)
    codes, w = rng.integers(0, 200, (3000, 5)).astype(np.uint8), rng.integers(0, 3, (2, 3000))
    s = Settings(1, 0, 2, 1, 2, True, 5)
    heavy = 1 << 17  # the same shares, but weights that do not fit in 16 bits
    light, same = grow(codes, w[0], w[1], 11, 0, s), grow(codes, w[0] * heavy, w[1] * heavy, 11, 0, Settings(1, 0, 2 * heavy, heavy, 2, True, 5))
    pure = [(a == b).all() for a, b in zip(light[:4], same[:4])]
    assert len(light[0]) > 500 and all(pure) and np.allclose(light[4], same[4])
    calls, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a: calls.append(len(x)) or plain(x, *a))
    grow(codes, w[0], w[1], 11, 1, Settings(1, 2, 2, 1, 2, True, 5))
    assert len(calls) > 4  # upper nodes are counted by bin, not sorted


@pytest.mark.parametrize("queue", [False, True])
def test_stored_trees_score_like_held_ones(spark, table, tmp_path, monkeypatch, queue):
    """Trees beyond heldBytes stay in a table that the driver does not read, when they are fitted, scored, cut and saved."""
    kw = dict(numTrees=6, seed=3, **(dict(smallBytes=0, nodeRows=60, treeBatch=4) if queue else {}))
    held, stored = HistogramForest(**kw).fit(table), HistogramForest(**kw, heldBytes=0).fit(table)
    assert held._stored is None and stored._held is None
    assert stored.trees.equals(held.trees)
    monkeypatch.setattr(forest, "_PART", 1500)  # several parts and blocks
    monkeypatch.setattr(forest, "_POINTS", 4000)
    twice = table.unionByName(table.where("row_key < 20")).withColumn("other", F.col("row_key") * 2)
    monkeypatch.setattr(HistogramForestModel, "trees", property(lambda self: pytest.fail("trees came to the driver")))
    got = stored.transform(twice)
    assert got.columns == [*twice.columns, "score", "prediction"]
    want, found = (sorted((r.row_key, r.other, round(r.score, 12), r.prediction) for r in d.collect()) for d in (held.transform(twice), got))
    assert found == want and len(want) == 420
    save_model(PipelineModel([stored]), str(tmp_path), "forest")
    assert load_model(str(tmp_path), "forest").transform(table).count() == table.count()
    few, low = ({r.row_key: r.score for r in m.part(4, 2).transform(table).collect()} for m in (held, stored))
    assert few == pytest.approx(low, abs=1e-12) and few != {w[0]: w[2] for w in want}


@pytest.mark.parametrize("queue", [False, True])
def test_depths_share_a_fit(table, monkeypatch, queue):
    kw = dict(seed=5, **(dict(smallBytes=0, nodeRows=60) if queue else {}))
    estimator = HistogramForest(**kw)
    grid = [{estimator.numTrees: n, estimator.maxDepth: d} for n in (2, 5) for d in (0, 1, 3)]
    apart = [estimator.fit(table, params) for params in grid]
    count, real = [], HistogramForest._fit
    monkeypatch.setattr(HistogramForest, "_fit", lambda self, rows: count.append(1) or real(self, rows))
    models = dict(estimator.fitMultiple(table, grid))
    assert len(count) == 1
    for i, alone in enumerate(apart):
        if not queue:
            assert models[i].trees.equals(alone.trees)
        assert models[i].getMaxDepth() == alone.getMaxDepth()
        a, b = ({r.row_key: r.score for r in m.transform(table).collect()} for m in (models[i], alone))
        assert a == b


def test_many_copies_are_drawn_without_a_generator_for_each_row(monkeypatch):
    key, made = np.random.default_rng(1).integers(0, 2**63, 40_000).astype(np.uint64), []
    monkeypatch.setattr(np.random, "default_rng", lambda seed, own=np.random.default_rng: made.append(seed) or own(seed))
    for copies in (17, 60, 360, 5000):
        drawn = _draw(key, np.full(len(key), copies), 9, 1)
        assert abs(drawn.mean() - copies) < 5 * (copies / len(key)) ** 0.5
        assert abs(drawn.var() / copies - 1) < 0.05
        half = slice(0, None, 2)
        assert (drawn[half] == _draw(key[half], np.full(len(key) // 2, copies), 9, 1)).all()
    assert not made
    mixed = _draw(key[:4], np.array([3, 70_000, 65_536, 40]), 9, 1)
    assert len(made) == 2 and abs(mixed - [3, 70_000, 65_536, 40]).max() < 2_000


@pytest.mark.parametrize("low", [0, 1 << 27])
def test_sums_beyond_one_number_and_sorted_bins_grow_the_same_tree(low):
    rng = np.random.default_rng(2)
    codes = np.stack([rng.integers(0, top, 600) for top in (3, 40, 256)], axis=1).astype(np.uint8)
    w0, w1 = rng.integers(0, 3, 600), rng.integers(0, 3, 600)
    s = Settings(1, 0, 2, 1, 2, False, 5)
    whole = grow(codes, w0 + low, w1 + low, 77, 0, s)
    again = grow(codes[::-1].copy(), w0[::-1] + low, w1[::-1] + low, 77, 0, s)
    assert all((a == b).all() for a, b in zip(whole[:5], again[:5])) and np.allclose(whole[5], again[5])
    feature, cut, left, right, share, _ = whole
    at = np.zeros(600, int)
    while (inner := feature[at] >= 0).any():
        at = np.where(inner, np.where(codes[np.arange(600), feature[at]] <= cut[at], left[at], right[at]), at)
    for leaf in np.unique(at):
        own = (w0 + low)[at == leaf].sum(), (w1 + low)[at == leaf].sum()
        assert share[leaf] == own[1] / max(1, sum(own))


def test_no_tree_leaves_its_task_for_importances(table, monkeypatch):
    seen, real = [], HistogramForest._grown
    monkeypatch.setattr(HistogramForest, "_grown", lambda self, *a, **kw: seen.append(real(self, *a, **kw)) or seen[-1])
    found = HistogramForest(numTrees=5).importances(table)
    assert seen[0].columns == ["tree", "importance"] and sum(found) == pytest.approx(1)
    assert HistogramForest(numTrees=5, smallBytes=0).importances(table) == pytest.approx(found)
