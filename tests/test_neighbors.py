import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labelrank.operators.bayes import GaussianNaiveBayes
from labelrank.operators.neighbors import NearestNeighbors

CELLS = {"broadcastRows": 0, "blockRows": 40, "pivots": 12}


def frame(spark, points, labels, start=0):
    rows = [(start + i, float(y), [float(v) for v in x]) for i, (x, y) in enumerate(zip(points, labels))]
    return spark.createDataFrame(rows, "row_key bigint, label double, x array<double>").select(
        "row_key", "label", array_to_vector("x").alias("features"))


def brute(queries, train, k, p):
    d = (np.abs(queries[:, None] - train[None]) ** p).sum(axis=2) ** (1 / p)
    return [[(j, d[i, j]) for j in sorted(range(len(train)), key=lambda j: (d[i, j], j))[:k]] for i in range(len(queries))]


def found(model, queries):
    out = {}
    for r in sorted(model.neighbors(queries).collect(), key=lambda r: (r.query, r.dist, r.train)):
        out.setdefault(r.query, []).append((r.train, r.dist))
    return out


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0, 2.5])
@pytest.mark.parametrize("how", [{}, CELLS], ids=["broadcast", "cells"])
def test_against_brute_force(spark, how, p):
    """Clusters, one of which holds a third of all rows as copies of one point, and scattered rows."""
    rng = np.random.default_rng(3)
    train = np.concatenate([np.full((150, 3), 2.0), rng.normal(0, 0.3, (150, 3)), rng.uniform(-9, 9, (150, 3))])
    labels = rng.integers(0, 2, len(train))
    queries = np.concatenate([np.full((60, 3), 2.0), rng.uniform(-9, 9, (60, 3))])
    model = NearestNeighbors(k=4, p=p, **how).fit(frame(spark, train, labels))
    got = found(model, frame(spark, queries, np.zeros(len(queries)), 1000))
    for i, want in enumerate(brute(queries, train, 4, p)):
        assert [j for j, _ in got[1000 + i]] == [j for j, _ in want]
        assert np.allclose([d for _, d in got[1000 + i]], [d for _, d in want])


def test_cells_that_are_too_far_are_not_visited(spark):
    rng = np.random.default_rng(5)
    centres = rng.uniform(-1000, 1000, (8, 2))
    train = np.concatenate([c + rng.normal(0, 1, (50, 2)) for c in centres])
    queries = centres + 0.5
    model = NearestNeighbors(k=3, p=2.0, broadcastRows=0, blockRows=1000, pivots=64).fit(frame(spark, train, np.zeros(400)))
    got = found(model, frame(spark, queries, np.zeros(8)))
    assert all([j for j, _ in got[i]] == [j for j, _ in want] for i, want in enumerate(brute(queries, train, 3, 2.0)))


@pytest.mark.parametrize("how", [{}, CELLS], ids=["broadcast", "cells"])
def test_votes(spark, how):
    train = frame(spark, [[0.0], [1.0], [3.0], [10.0], [12.0]], [1, 0, 0, 0, 1])
    queries = frame(spark, [[0.0], [1.5], [11.0]], [0, 0, 0], 100)
    out = {r.row_key: r for r in NearestNeighbors(k=2, p=3.0, **how).fit(train).transform(queries).collect()}
    assert out[100].prediction == 1.0 and out[100].score == 1.0  # distance 0 takes all the weight
    # 0.0 and 3.0 are equally far from 1.5 and the smaller key is taken: weights 1/0.5 for label 0, 1/1.5 for label 1.
    assert out[101].prediction == 0.0 and np.isclose(out[101].score, 0.25)
    assert out[102].prediction == 0.0 and out[102].score == 0.5  # equal votes fall to the smaller label
    uniform = NearestNeighbors(k=2, p=3.0, weights="uniform", **how).fit(train).transform(queries)
    assert {r.row_key: r.score for r in uniform.collect()}[100] == 0.5


@pytest.mark.parametrize("how", [{}, CELLS], ids=["broadcast", "cells"])
def test_fewer_rows_than_neighbours(spark, how):
    model = NearestNeighbors(k=5, **how).fit(frame(spark, [[0.0], [1.0]], [1, 0]))
    assert len(found(model, frame(spark, [[0.2]], [0], 9))[9]) == 2


def test_result_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(11)
    train, queries = frame(spark, rng.normal(size=(200, 4)), rng.integers(0, 3, 200)), frame(spark, rng.normal(size=(50, 4)), np.zeros(50))
    results = [
        sorted(tuple(r) for r in NearestNeighbors(k=3, **how).fit(train.repartition(n)).elected(queries.repartition(n)).collect())
        for how in ({}, CELLS) for n in (1, 7)
    ]
    keys = [[r[:2] for r in rows] for rows in results]
    assert all(k == keys[0] for k in keys)


def test_bayes_by_hand(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(1.5, 2, (25, 3))])
    y = np.array([0] * 40 + [1] * 25)
    out = GaussianNaiveBayes().fit(frame(spark, x, y)).transform(frame(spark, x, y)).orderBy("row_key").toPandas()
    eps = 9.748288799431293e-07 * x.var(axis=0).max()
    ll = np.stack([
        np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * (x[y == c].var(axis=0) + eps)) + (x - x[y == c].mean(axis=0)) ** 2 / (x[y == c].var(axis=0) + eps)).sum(axis=1)
        for c in (0, 1)
    ], axis=1)
    assert (out.prediction == ll.argmax(axis=1)).all()
    assert np.allclose(out.score, 1 / (1 + np.exp(ll[:, 0] - ll[:, 1])))


def test_bayes_wide_equals_written_out(spark, monkeypatch):
    from labelrank.operators import bayes

    rng = np.random.default_rng(4)
    df = frame(spark, rng.normal(size=(60, 5)), rng.integers(0, 3, 60))
    a = GaussianNaiveBayes().fit(df).transform(df).orderBy("row_key").toPandas()
    monkeypatch.setattr(bayes, "UNROLLED", 0)
    b = GaussianNaiveBayes().fit(df).transform(df).orderBy("row_key").toPandas()
    assert (a.prediction == b.prediction).all() and np.allclose(a.score, b.score)


def test_bayes_with_one_class(spark):
    df = frame(spark, [[1.0], [2.0]], [0, 0])
    assert [r.score for r in GaussianNaiveBayes().fit(df).transform(df).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        GaussianNaiveBayes().fit(df.where(F.lit(False)))


def test_null_key_raises(spark):
    import pytest
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from labelrank.operators.neighbors import NearestNeighbors

    rows = spark.createDataFrame([(i, float(i % 2), [float(i)]) for i in range(6)], "row_key bigint, label double, f array<double>").withColumn("features", array_to_vector(F.col("f")))
    model = NearestNeighbors(k=1, p=2.0, weights="uniform", keyCol="row_key").fit(rows)
    with pytest.raises(Exception, match="null in the row key"):
        model.transform(rows.withColumn("row_key", F.when(F.col("row_key") > 0, F.col("row_key")))).collect()


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0, 2.5])
def test_products_find_the_same_pairs(p, monkeypatch):
    """Ties, copies and rows far from the origin: pair for pair what all distances give, hardly any of them measured."""
    from labelrank.operators import neighbors

    rng = np.random.default_rng(8)
    train = np.round(rng.normal(size=(6000, 6)), 1) + 50
    train[10:90] = train[4]
    queries = np.concatenate([train[:20], rng.normal(size=(600, 6)) + 50])
    want = neighbors._nearest_plain(queries, train, 5, p)
    measured, plain = [], neighbors._paired
    monkeypatch.setattr(neighbors, "_paired", lambda a, b, q, t, p: measured.append(len(q)) or plain(a, b, q, t, p))
    got = neighbors._nearest(queries, train, 5, p)
    assert all((x == y).all() for x, y in zip(got, want))
    assert 0 < sum(measured) < len(queries) * len(train) / 5


def test_copies_of_rows_do_not_grow_with_the_square(spark):
    """Cells rule out nothing here: a row goes to a bounded number of blocks, not to one for every 20 rows."""
    rng = np.random.default_rng(9)
    train, queries = rng.normal(size=(1500, 40)), rng.normal(size=(500, 40))
    model = NearestNeighbors(k=3, p=3.0, broadcastRows=0, blockRows=20, pivots=16).fit(frame(spark, train, np.zeros(1500)))
    plan = model.neighbors(frame(spark, queries, np.zeros(500), 5000))
    got = {}
    for r in plan.orderBy("query", "dist", "train").collect():
        got.setdefault(r.query, []).append(r.train)
    assert all(got[5000 + i] == [j for j, _ in want] for i, want in enumerate(brute(queries, train, 3, 3.0)))
    explodes = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "reachable" not in explodes


@pytest.mark.parametrize("k", [1, 3, 6])
def test_the_own_cell_bounds_the_search_in_others(spark, k):
    """Small cells, copies at one distance, and a query key that two rows have: the rows found are those of brute force."""
    rng = np.random.default_rng(12)
    train = np.round(np.concatenate([rng.normal(size=(300, 2)), rng.normal(size=(40, 2)) * 9, np.zeros((30, 2))]), 1)
    queries = np.round(rng.normal(size=(60, 2)) * 3, 1)
    model = NearestNeighbors(k=k, p=3.0, broadcastRows=0, blockRows=40, pivots=60).fit(frame(spark, train, np.zeros(len(train))))
    asked = frame(spark, queries, np.zeros(60), 1000)
    plan = model.neighbors(asked.unionByName(frame(spark, queries[:1] + 5, np.zeros(1), 1000)))
    got = {}
    for r in plan.orderBy("query", "dist", "train").collect():
        got.setdefault(r.query, []).append((r.train, r.dist))
    both = sorted(brute(queries[:1], train, k, 3.0)[0] + brute(queries[:1] + 5, train, k, 3.0)[0], key=lambda h: (round(h[1], 9), h[0]))[:k]
    wanted = [both, *brute(queries[1:], train, k, 3.0)]
    assert [[t for t, _ in got[1000 + i]] for i in range(60)] == [[t for t, _ in w] for w in wanted]
    assert "_bound" in plan._jdf.queryExecution().optimizedPlan().toString()
