import pytest
from pyspark.sql import functions as F

from labelrank.operators import evaluate, profile


def report(spark, pairs, **kw):
    df = spark.createDataFrame(pairs, "label int, prediction int")
    return {r.label: tuple(round(r[c], 6) for c in ("precision", "recall", "f1_score", "support")) for r in evaluate.class_report(df, **kw).collect()}


def test_report_by_hand(spark):
    got = report(spark, [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 1 + [(1, 0)] * 1)
    assert got == {
        "0": (round(6 / 7, 6), 0.75, 0.8, 8.0), "1": (round(1 / 3, 6), 0.5, 0.4, 2.0), "accuracy": (0.7,) * 4,
        "macro avg": (round((6 / 7 + 1 / 3) / 2, 6), 0.625, 0.6, 10.0),
        "weighted avg": (round((6 / 7 * 8 + 1 / 3 * 2) / 10, 6), 0.7, 0.72, 10.0),
    }


@pytest.mark.parametrize("zero", [0.0, 1.0])
def test_class_never_predicted_and_never_true(spark, zero):
    never_predicted = report(spark, [(0, 0), (1, 0)], zero_division=zero)
    assert never_predicted["1"] == (zero, 0.0, 0.0, 1.0)
    never_true = report(spark, [(0, 0), (0, 1)], zero_division=zero)
    assert never_true["1"] == (0.0, zero, 0.0, 0.0)
    assert never_true["weighted avg"] == (1.0, 0.5, round(2 / 3, 6), 2.0)


def test_single_class_and_other_types(spark):
    assert report(spark, [(1, 1)] * 3) == {"1": (1, 1, 1, 3), "accuracy": (1,) * 4, "macro avg": (1, 1, 1, 3), "weighted avg": (1, 1, 1, 3)}
    doubles = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0)], "label double, prediction double")
    assert {r.label for r in evaluate.class_report(doubles).collect()} >= {"0", "1"}
    texts = spark.createDataFrame([("no", "yes"), ("yes", "yes")], "label string, prediction string")
    assert {r.label for r in evaluate.class_report(texts).collect()} >= {"no", "yes"}


def test_accuracy_mae_weight(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (0, 0)], "label int, prediction int")
    assert tuple(evaluate.accuracy_mae(df).first()) == (0.75, 0.25)
    counts = evaluate.confusion(df.withColumn("m", F.lit("x")), by=["m"])
    assert tuple(evaluate.metrics_from_confusion(counts, ["m"]).first()) == ("x", 0.75, 0.25)
    assert tuple(evaluate.class_weight(df).first()) == (4, 2, 2.0)
    assert evaluate.class_weight(df.where("label = 0")).first()["weight"] is None


def test_leaderboard_means_best(spark):
    metrics = spark.createDataFrame(
        [("b", 0.9), ("a", 0.9), ("c", None), ("d", 0.95)], "model string, accuracy double")
    assert [(r["rank"], r.model) for r in evaluate.leaderboard(metrics).orderBy("rank").collect()] == [(1, "d"), (2, "a"), (3, "b")]
    folds = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("a", 0.0, 4.0, 5.0)], "model string, accuracy double, train_time double, prediction_time double")
    assert tuple(evaluate.fold_means(folds).first()) == ("a", 0.5, 3.0, 4.0)
    cands = spark.createDataFrame(
        [("a", 0, {"k": "3"}, 0.5), ("a", 1, {"k": "5"}, 0.7), ("a", 2, {"k": "7"}, 0.7)],
        "model string, candidate int, params map<string,string>, mean_accuracy double")
    best = evaluate.best_params(cands).first()
    assert best.params == {"k": "5"} and best.mean_accuracy == 0.7
    assert evaluate.append_all([cands, cands.select(*reversed(cands.columns))]).count() == 6


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, True), (30.0, False), (30.0, False), (1.0, True), (None, True)], "x double, won boolean")
    got = {(r.series, r.bin): r.n for r in profile.histogram(df, "x", "won").collect()}
    assert len(got) == 60
    assert got["all", 30] == 2 and got["all", 1] == 1 and got["all", 2] == 1 and got["all", 15] == 0
    assert got["winners", 1] == 1 and got["winners", 30] == 1
    flat = {r.bin: r.n for r in profile.histogram(spark.createDataFrame([(5.0,)] * 4, "x double"), "x").collect()}
    assert sum(flat.values()) == 4 and max(flat.values()) == 4
    assert profile.histogram(df.where("x > 100"), "x").count() == 0


def test_density_by_hand(spark):
    import numpy as np

    x = np.array([0.0, 1.0, 1.0, 1.0, 2.0, 5.0, 100000.0])
    out = profile.density(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").orderBy("point").toPandas()
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(axis=1) / (len(x) * bw * np.sqrt(2 * np.pi))
    assert np.allclose(out.x, grid) and np.allclose(out.density, want, rtol=1e-9, atol=0)
    assert np.allclose(out.scaled, want * len(x) * (x.max() - x.min()) / 30)
    assert profile.density(spark.createDataFrame([(5.0,)] * 4, "x double"), "x").count() == 0


def test_density_skips_far_values_without_loss(spark):
    """Two narrow heaps far apart: most grid points are out of reach of most values."""
    import numpy as np

    x = np.concatenate([np.linspace(0, 1, 3000), np.linspace(9, 10, 30)])
    out = profile.density(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", points=50).orderBy("point").toPandas()
    bw = x.std(ddof=1) * len(x) ** -0.2
    want = np.exp(-0.5 * ((np.linspace(0, 10, 50)[:, None] - x) / bw) ** 2).sum(axis=1) / (len(x) * bw * np.sqrt(2 * np.pi))
    assert np.allclose(out.density, want, rtol=1e-9)


def test_density_sends_one_row_per_cell(spark):
    import numpy as np

    x = np.random.default_rng(2).lognormal(size=20_000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    found = profile.density(df, "x", points=100)
    out = found.orderBy("point").toPandas()
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 100)
    want = np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(axis=1) / (len(x) * bw * np.sqrt(2 * np.pi))
    assert np.abs(out.density - want).max() < 1e-12 and (out.density >= 0).all()
    high = want > 1e-15
    assert np.allclose(out.density[high], want[high], rtol=1e-9, atol=0)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    spread = [i for i, line in enumerate(lines) if "Generate explode" in line and "middle" in line]
    moments = [i for i, line in enumerate(lines) if "Aggregate [series" in line and "AS m11" in line]
    assert len(spread) == len(moments) == 1 and spread < moments  # points meet cells, not values


def test_density_of_flagged_rows_nulls_and_far_heaps(spark):
    rows = [(0.0, True), (1.0, False), (2.0, None), (None, True), (float("nan"), False), (1e6, True), (1e6, True)]
    out = profile.density(spark.createDataFrame(rows, "x double, won boolean"), "x", "won", points=3).collect()
    assert sorted((r.series, r.point) for r in out) == [(s, p) for s in ("all", "winners") for p in range(3)]
    assert all(r.density >= 0 and r.scaled >= 0 for r in out)
