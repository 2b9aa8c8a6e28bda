"""Which fits begin first; the models keep the order of their names."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector

from labelrank.operators import network
from labelrank.operators.bayes import GaussianNaiveBayes
from labelrank.operators.boosting import HistogramBoosting
from labelrank.operators.network import FeedForward
from labelrank.plans import stacking, training


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    rows = [(i, [float(v) for v in a], float(a[0] > 0)) for i, a in enumerate(x)]
    return spark.createDataFrame(rows, "row_key int, x array<double>, label double").withColumn("features", array_to_vector("x")).drop("x")


@pytest.fixture
def begun(monkeypatch):
    """Names of fitted classes in the order in which their fits were handed over, and how many at a time."""
    seen, real = [], {c: c._fit for c in (GaussianNaiveBayes, HistogramBoosting, FeedForward)}
    for c, fit in real.items():
        monkeypatch.setattr(c, "_fit", lambda self, d, c=c, fit=fit: seen.append(c.__name__) or fit(self, d))
    one_by_one = lambda spark, actions, many: seen.append(many) or [a() for a in actions]
    for module in (training, stacking):
        monkeypatch.setattr(module, "at_once", one_by_one)
    return seen


def test_longest_chains_of_steps_begin_first(spark, table, begun):
    models = {"Bayes": GaussianNaiveBayes(), "Boosted": HistogramBoosting(maxIter=2), "Net": FeedForward(layers=[3, 2, 1], maxIter=1)}
    found = training.fit_all(models, table, 2)
    assert list(found) == list(models) and begun == [max(2, spark.sparkContext.defaultParallelism), "FeedForward", "HistogramBoosting", "GaussianNaiveBayes"]
    begun.clear()
    training.fit_all(models, table, 1)
    assert begun == [1, "GaussianNaiveBayes", "HistogramBoosting", "FeedForward"]


def test_stacked_models_too(spark, table, begun):
    bases = [GaussianNaiveBayes(), HistogramBoosting(maxIter=2)]
    model = stacking.Stacking(bases, LogisticRegression(regParam=0.1), folds=2).fit(table)
    assert begun == [max(4, spark.sparkContext.defaultParallelism), *["HistogramBoosting"] * 3, *["GaussianNaiveBayes"] * 3]
    assert [type(m).__name__ for m in model.bases] == ["GaussianNaiveBayesModel", "HistogramBoostingModel"]


def test_dropout_by_whole_numbers_is_that_by_chance():
    from labelrank.operators.boosting import _mixed

    key = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    unit = _mixed(np.arange(1, 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(77))
    chance = (_mixed(key[:, None] ^ unit[None, :]) >> np.uint64(11)).astype(float) / 2**53
    for share in (0.1, 0.3, 0.5, 0.999):
        assert (network.kept(key, 7, share, 77) == (chance >= share) / (1 - share)).all()
