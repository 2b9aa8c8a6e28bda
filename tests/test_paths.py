"""Settings that share a fit or a search give what separate fits give."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from labelrank.operators.boosting import HistogramBoosting
from labelrank.operators.forest import HistogramForest
from labelrank.operators.neighbors import NearestNeighbors
from labelrank.operators.network import FeedForward
from labelrank.operators.paths import Handed, predict_each
from labelrank.operators.split import stratified_kfold
from labelrank.plans import tuning
from tests.test_neighbors import frame


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    y = (np.arange(150) % 3 == 0).astype(int)
    return frame(spark, np.round(rng.normal(size=(150, 3)) + y[:, None], 1), y).repartition(3).cache()


def searches():
    boosted, forest = HistogramBoosting(maxDepth=3, grow="level"), HistogramForest(maxDepth=4, seed=5)
    near, net = NearestNeighbors(k=5, p=2.0), FeedForward(layers=[3, 4, 1], keyCol="row_key", epochsPerJob=4)
    return {
        "boosted": (boosted, ParamGridBuilder().addGrid(boosted.maxIter, [2, 9]).addGrid(boosted.stepSize, [0.1, 0.5]).build()),
        "forest": (forest, ParamGridBuilder().addGrid(forest.numTrees, [3, 8]).build()),
        "near": (near, ParamGridBuilder().addGrid(near.k, [1, 4, 7]).addGrid(near.weights, ["uniform", "distance"]).build()),
        "net": (net, ParamGridBuilder().addGrid(net.maxIter, [3, 6]).build()),
    }


@pytest.mark.parametrize("name, fits", [("boosted", 2), ("forest", 1), ("near", 1), ("net", 1)])
def test_shared_fits_equal_separate_ones(table, monkeypatch, name, fits):
    estimator, grid = searches()[name]
    apart = [estimator.fit(table, params).transform(table) for params in grid]
    count, kind = [], type(estimator)
    inner = "_fit_path" if name == "net" else "_fit"
    real = getattr(kind, inner)
    monkeypatch.setattr(kind, inner, lambda self, *a: count.append(1) or real(self, *a))
    models = dict(estimator.fitMultiple(table, grid))
    assert sorted(models) == list(range(len(grid))) and len(count) == fits
    for i, alone in enumerate(apart):
        for p, v in grid[i].items():
            assert models[i].getOrDefault(p.name) == v
        want = {r.row_key: (r.prediction, r.score) for r in alone.collect()}
        assert {r.row_key: (r.prediction, r.score) for r in models[i].transform(table).collect()} == want
    both = predict_each([models[i] for i in range(len(grid))], table).collect()
    for i, alone in enumerate(apart):
        assert {r.row_key: r[f"_p{i}"] for r in both} == {r.row_key: r.prediction for r in alone.collect()}


def test_search_equals_separate_fits(table):
    found = tuning.grid_search(table, searches(), k=3, parallelism=4)
    rows = stratified_kfold(table, "label", "row_key", 3, 42, "_fold").cache()
    got = {(r.model, r.candidate): r.mean_accuracy for r in found.collect()}
    want = {}
    for name in ("boosted", "near"):
        estimator, grid = searches()[name]
        for i, params in enumerate(grid):
            each = [
                estimator.fit(rows.where(F.col("_fold") != f), params).transform(rows.where(F.col("_fold") == f))
                .agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] for f in range(3)]
            want[name, i] = pytest.approx(float(np.mean(each)), abs=1e-12)
    assert {k: v for k, v in got.items() if k in want} == want
    assert len(got) == 4 + 2 + 6 + 2
    assert {r.candidate: r.params for r in found.where("model = 'boosted'").collect()}[3] == {"maxIter": "9", "stepSize": "0.5"}


def test_folds_without_rows_have_no_accuracy(spark):
    few = frame(spark, [[0.0], [1.0], [0.1], [1.1]], [0, 1, 0, 1])
    near = NearestNeighbors(k=1)
    got = tuning.grid_search(few, {"near": (near, [{near.k: 1}])}, k=4, stratify=False).first()
    assert got.mean_accuracy is not None


def test_handed_out_to_threads():
    fitted = []

    def fit(group):
        fitted.append(tuple(group))
        return [f"m{i}" for i in group]

    handed = Handed([[0, 3], [1], [2, 4, 5]], fit)
    with ThreadPoolExecutor(6) as pool:
        found = list(pool.map(lambda _: next(handed), range(6)))
    assert sorted(found) == [(i, f"m{i}") for i in range(6)] and sorted(fitted) == [(0, 3), (1,), (2, 4, 5)]
    assert list(handed) == [] and list(Handed([], fit)) == []
