"""The network against finite differences and steps by hand."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labelrank.operators.network import FeedForward, _unpack, gradients, kept, scores, start, step, weights
from labelrank.sources.tables import load_model, save_model


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 3))
    return x, ((x[:, 0] * x[:, 1] > 0)).astype(float)


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(*data))]
    return spark.createDataFrame(rows, "row_key int, x array<double>, label double").withColumn("features", array_to_vector("x")).drop("x").repartition(4)


def loss(flat, layers, x, y, masks):
    for (w, b), mask in zip(_unpack(flat, layers)[:-1], masks):
        x = np.maximum(x @ w + b, 0) * mask
    w, b = _unpack(flat, layers)[-1]
    z = (x @ w + b)[:, 0]
    return (np.logaddexp(0, z) - y * z).sum()


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_gradients_equal_finite_differences(data, share):
    x, y = data[0][:20], data[1][:20]
    layers = [3, 6, 5, 1]
    flat = start(layers, 1)
    flat += np.random.default_rng(2).normal(scale=0.1, size=len(flat))
    key = np.arange(20, dtype=np.uint64)
    masks = [kept(key, u, share, i) for i, u in enumerate(layers[1:-1])]
    got = gradients(flat, layers, x, y, masks)
    for i in range(weights(layers)):
        d = np.zeros_like(flat)
        d[i] = 1e-6
        assert got[i] == pytest.approx((loss(flat + d, layers, x, y, masks) - loss(flat - d, layers, x, y, masks)) / 2e-6, abs=1e-5)


def test_no_rows_no_gradient():
    layers = [3, 4, 1]
    assert not gradients(start(layers, 1), layers, np.zeros((0, 3)), np.zeros(0), [1.0]).any()


def test_dropout_keeps_the_mean_and_follows_the_key():
    key = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    mask = kept(key, 20, 0.3, 5)
    assert set(np.unique(mask)) == {0.0, 1 / 0.7} and mask.mean() == pytest.approx(1, abs=0.02)
    assert (kept(key[::-1], 20, 0.3, 5)[::-1] == mask).all() and (kept(key, 20, 0.3, 6) != mask).any()


def test_steps_by_hand():
    g = np.array([0.5, -2.0])
    for optimizer, want in {
        "sgd": -0.1 * g, "rmsprop": -0.1 * g / (np.sqrt(0.1 * g * g) + 1e-7),
        "adam": -0.1 * np.sign(g),  # the first step of all has the same length
    }.items():
        state = np.zeros((3, 2))
        step(state, g, 1, optimizer, 0.1)
        assert state[0] == pytest.approx(want, rel=1e-5)
    step(state, 2 * g, 2, "adam", 0.1)
    m, v = (0.9 * 0.1 + 0.2) * g / (1 - 0.81), (0.999 * 0.001 + 0.004) * g * g / (1 - 0.999**2)
    assert state[0] == pytest.approx(-0.1 * np.sign(g) - 0.1 * m / np.sqrt(v), rel=1e-5)


def test_whole_batches_equal_plain_descent(table, data):
    """One batch per epoch without dropout is gradient descent on all rows."""
    x, y = data
    layers = [3, 4, 1]
    model = FeedForward(layers=layers, optimizer="sgd", stepSize=0.5, batchSize=300, maxIter=5, epochsPerJob=2).fit(table)
    flat = start(layers, 42)
    for _ in range(5):
        flat -= 0.5 * gradients(flat, layers, x, y, [1.0]) / len(y)
    assert model.weights == pytest.approx(flat, abs=1e-12)
    got = {r.row_key: r.score for r in model.transform(table).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(scores(flat, layers, x), abs=1e-9)


def test_repeats_bit_for_bit_and_tasks_agree(table):
    kw = dict(layers=[3, 8, 4, 1], dropout=[0.0, 0.3], maxIter=3, keyCol="row_key")
    first = FeedForward(**kw, tasks=2).fit(table).weights
    assert FeedForward(**kw, tasks=2, epochsPerJob=1).fit(table.repartition(3)).weights == first
    assert FeedForward(**kw, tasks=1).fit(table).weights == pytest.approx(first, abs=1e-9)


def test_learns_and_is_saved(spark, table, tmp_path):
    model = FeedForward(layers=[3, 32, 16, 1], stepSize=0.01, maxIter=60, keyCol="row_key").fit(table)
    out = model.transform(table)
    assert out.where("prediction = label").count() > 285
    save_model(PipelineModel([model]), str(tmp_path), "net")
    back = load_model(str(tmp_path), "net").transform(table)
    assert {r.row_key: r.score for r in back.collect()} == {r.row_key: r.score for r in out.collect()}


def test_bad_input(table):
    net = FeedForward(layers=[3, 4, 1], maxIter=1)
    for bad in (table.limit(0), table.withColumn("label", F.lit(2.0))):
        with pytest.raises(ValueError, match="label"):
            net.fit(bad)
    for layers, kw in (([3, 4, 2], {}), ([3, 4, 1], {"dropout": [0.1, 0.1]}), ([3, 4, 1], {"optimizer": "other"})):
        with pytest.raises(ValueError, match="layers"):
            FeedForward(layers=layers, **kw).fit(table)
    with pytest.raises(ValueError, match="4 numbers"):
        FeedForward(layers=[4, 4, 1]).fit(table)


def test_gradients_into_views_are_those_by_formula():
    """The buffers of a run are filled anew by every step, whatever they held."""
    from labelrank.operators import network

    layers, rng = [4, 5, 3, 1], np.random.default_rng(2)
    flat, x, y = network.start(layers, 3), rng.normal(size=(7, 4)), rng.integers(0, 2, 7).astype(float)
    masks = [network.kept(np.arange(7).astype(np.uint64), 5, 0.4, 9), 1.0]
    (w1, b1), (w2, b2), (w3, b3) = network._unpack(flat, layers)
    s1 = np.maximum(x @ w1 + b1, 0) * masks[0]
    s2 = np.maximum(s1 @ w2 + b2, 0)
    d3 = (1 / (1 + np.exp(-(s2 @ w3 + b3))) - y[:, None])
    d2 = (d3 @ w3.T) * (s2 > 0)
    d1 = (d2 @ w2.T) * (s1 > 0) * masks[0]
    want = np.concatenate([v for a, d in ((x, d1), (s1, d2), (s2, d3)) for v in ((a.T @ d).ravel(), d.sum(axis=0))])
    held = np.full(len(flat) + 1, 8.0)
    for _ in range(2):
        network._gradients(network._unpack(flat, layers), network._unpack(held[:-1], layers), x, y, masks)
        assert np.allclose(held[:-1], want, atol=1e-12) and held[-1] == 8.0
