import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from labelrank.operators.boosting import HistogramBoosting
from labelrank.operators.forest import HistogramForest
from labelrank.operators.network import FeedForward
from labelrank.plans import registry, scoring, training, tuning
from labelrank.sources.tables import load_model, save_model
from tests.test_neighbors import frame


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    y = (np.arange(240) % 4 == 0).astype(int)
    df = frame(spark, rng.normal(size=(240, 4)) + y[:, None] * 2.5, y)
    season, player = (F.col("row_key") % 6 + 2015).cast("int"), F.concat(F.lit("p"), F.col("row_key"))
    return df.withColumn("season", season).withColumn("player", player).repartition(4).cache()


@pytest.fixture(scope="module")
def fitted(table):
    shape = registry.shape_of(table, 4)
    weighted = registry.add_weight(table, shape)
    return {n: m.fit(weighted) for n, m in registry.models(shape, boosting_rounds=4, weight="weight").items()}


def test_shape_and_weight(table):
    shape = registry.shape_of(table, 4)
    assert (shape.rows, shape.positives) == (240, 60) and shape.reg(2.0) == 1 / 480
    weights = {r.label: r.weight for r in registry.add_weight(table, shape).select("label", "weight").distinct().collect()}
    assert weights == {0.0: 1.0, 1.0: 4.0}


def test_registry_settings(table):
    found = registry.models(registry.shape_of(table, 4))
    assert found["RandomForest"].getNumTrees() == 1000 and found["RandomForest"].getMaxDepth() == 10
    assert found["BoostedTreesWeighted"].getMaxIter() == 1000 and found["BoostedTreesDeep"].getMaxIter() == 500
    assert found["BoostedTreesLeafy"].getMinInstancesPerNode() == 20 and found["ANN"].getLayers() == [4, 50, 50, 50, 1]
    grids = {n: len(g) for n, (_, g) in registry.tuned_models(registry.shape_of(table, 4)).items()}
    assert grids == {"RandomForest": 9, "BoostedTreesA": 9, "BoostedTreesB": 9, "KNN": 6, "SVM": 3, "GaussianNB": 1,
                     "LogisticRegression": 3, "ANN": 12, "Stacking": 1}


def test_scores_separate_the_classes(table, fitted):
    scored = scoring.score_all(fitted, table, ["row_key", "label"]).cache()
    assert scored.count() == 240 * len(fitted)
    assert set(r.prediction for r in scored.select("prediction").distinct().collect()) <= {0, 1}
    for name in fitted:
        part = scored.where(F.col("model") == name)
        if name != "SVM":
            assert part.where(~F.col("score").between(0, 1)).count() == 0
        assert BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(part) > 0.8, name


def test_same_seed_same_scores(table):
    shape = registry.shape_of(table, 4)
    for name in ("RandomForest", "BoostedTreesDeep", "ANN"):
        a, b = (registry.models(shape, boosting_rounds=3)[name].fit(table) for _ in range(2))
        diff = scoring.score_all({"a": a, "b": b}, table, ["row_key"]).groupBy("row_key").agg((F.max("score") - F.min("score")).alias("d"))
        assert diff.agg(F.max("d")).first()[0] == 0.0


def test_logistic_reaches_the_l1_optimum(spark):
    """The penalty factor is translated so that the minimum is that of C * total loss + |w|."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.logistic(size=300) > 0).astype(int)
    df = frame(spark, x, y)
    model = registry.models(registry.shape_of(df, 3))["LogisticL1"].copy().fit(df)
    w, b = model.coefficients.toArray(), model.intercept
    residual = 1 / (1 + np.exp(-(x @ w + b))) - y
    gradient = x.T @ residual
    assert abs(residual.sum()) < 0.05
    for g, c in zip(gradient, w):
        assert abs(g + math.copysign(1.0, c)) < 0.05 if c else abs(g) <= 1.05


def test_models_survive_saving(spark, table, fitted, tmp_path):
    stack = registry.stacking(registry.shape_of(table, 4), boosting_rounds=2, folds=2).fit(table)
    for name, model in {**fitted, "Stacking": stack}.items():
        save_model(PipelineModel([model]), str(tmp_path), name)
        again = load_model(str(tmp_path), name)
        both = scoring.score_all({"a": PipelineModel([model]), "b": again}, table, ["row_key"])
        assert both.groupBy("row_key").agg((F.max("score") - F.min("score")).alias("d")).agg(F.max("d")).first()[0] < 1e-9, name


def test_rank_seasons(table, fitted):
    out = scoring.rank_seasons({n: fitted[n] for n in ("RandomForest", "KNN")}, table, [2015, 2017, 2019], k=5)
    rows = {(r.season, r.model): r for r in out.collect()}
    assert set(rows) == {(s, m) for s in (2015, 2017, 2019) for m in ("RandomForest", "KNN")}
    assert rows[2015, "KNN"].mvp == "p0" and rows[2015, "KNN"].mvp_in_top_k is True
    assert all(len(r.top_k.split(", ")) == 5 for r in rows.values())


def test_external_network(spark, table):
    def make():
        return lambda x: x.reshape(len(x), 4).sum(axis=1)

    for axis in (False, True):
        out = scoring.score_external(table, make, 4, unit_axis=axis, batch_size=7).toPandas()
        assert np.allclose(out.score, [v.toArray().sum() for v in out.features], atol=1e-5)


def test_compare_holdout(spark, table, tmp_path):
    estimators = {n: m for n, m in registry.models(registry.shape_of(table, 4), boosting_rounds=3).items() if n in ("GaussianNB", "SVM")}
    found = training.compare(table, estimators, stratify=True, save_to=str(tmp_path))
    rows = found.metrics.collect()
    assert [r.model for r in found.leaderboard().orderBy("rank").collect()] and len(rows) == 2
    assert all(r.fold is None and r.cross_validation is False and r.train_time > 0 and r.prediction_time > 0 for r in rows)
    supports = {(r.model, r.label): r.support for r in found.reports.where("label in ('0', '1')").collect()}
    assert supports == {(m, c): n for m in estimators for c, n in (("0", 36.0), ("1", 12.0))}
    assert load_model(str(tmp_path), "GaussianNB").transform(table).count() == 240
    found.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "metrics")).count() == 2


def test_cross_validation_covers_every_row(table):
    found = training.compare(table, {"lr": LogisticRegression()}, cross_validate=True, k=3, final_fit=True)
    assert sorted(r.fold for r in found.metrics.collect()) == [0, 1, 2]
    assert found.reports.where("label in ('0', '1')").agg(F.sum("support")).first()[0] == 240
    mean, reports = training.cross_validate_model(table, LogisticRegression(), k=3)
    assert mean > 0.8 and math.isclose(mean, found.metrics.agg(F.avg("accuracy")).first()[0])
    assert found.mean_times().columns == ["model", "mean_accuracy", "mean_train_time", "mean_prediction_time"]


def test_label_that_is_not_binary_yet(table):
    soft = table.withColumn("share", F.when(F.col("label") == 1, 0.8).otherwise(0.1)).drop("label")
    found = training.compare(soft, {"lr": LogisticRegression()}, label="share")
    assert found.metrics.first().accuracy > 0.8


def test_grid_search_and_refit(table):
    searches = registry.tuned_models(registry.shape_of(table, 4), boosting_rounds=2, with_stacking=False)
    searches = {n: searches[n] for n in ("LogisticRegression", "ANN")}
    found = tuning.grid_search(table, searches, k=2, stratify=False).cache()
    assert {r.model: r["count"] for r in found.groupBy("model").count().collect()} == {"LogisticRegression": 3, "ANN": 12}
    best = tuning.best_settings(found, searches)
    top = {r.model: r.top for r in found.groupBy("model").agg(F.max("mean_accuracy").alias("top")).collect()}
    chosen = found.where("model = 'LogisticRegression'").orderBy(F.desc("mean_accuracy"), "candidate").first()
    assert chosen.mean_accuracy == top["LogisticRegression"]
    assert str(best["LogisticRegression"].getRegParam()) == chosen.params["regParam"]
    again = tuning.refit_best(table, found, searches, k=2)
    assert again.metrics.count() == 4


def test_a_score_column_is_not_taken_for_the_models(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from labelrank.plans.scoring import score_all

    rows = spark.createDataFrame([(i, float(i % 2), [float(i % 2), 1.0], 7.0) for i in range(20)], "row_key bigint, label double, f array<double>, score double")
    rows = rows.withColumn("features", array_to_vector(F.col("f")))
    got = score_all({"lr": LogisticRegression().fit(rows)}, rows, ["row_key"])
    assert got.where("score = 7.0").count() == 0 and got.count() == 20


def test_fit_all_fits_at_the_same_time(spark):
    """Two fits that wait for each other end, and the models keep their names."""
    import threading

    from pyspark.ml import Estimator

    met = threading.Barrier(2)

    class Waits(Estimator):
        def __init__(self, mark):
            super().__init__()
            self.mark = mark

        def _fit(self, dataset):
            met.wait(20)
            return self.mark

    assert training.fit_all({"b": Waits(1), "a": Waits(2)}, spark.range(1), 2) == {"b": 1, "a": 2}


def test_fits_of_one_task_begin_first_and_fill_the_cores(spark, monkeypatch):
    """Long chains of steps do not wait for fits that spread, and no core is left without a fit."""
    estimators = {
        "forest": HistogramForest(numTrees=1), "short": HistogramBoosting(maxIter=5), "net": FeedForward(layers=[1, 1]), "long": HistogramBoosting(maxIter=9)}
    asked, begun = [], []
    monkeypatch.setattr(training, "at_once", lambda spark, actions, parallelism: asked.append(parallelism) or [a() for a in actions])
    monkeypatch.setattr(training, "fit_and_count", lambda e, train, test: begun.append(type(e).__name__ + str(e.getMaxIter() if e.hasParam("maxIter") else "")) or (None, 1.0, 1.0, []))
    table = spark.range(10).selectExpr("id as row_key", "id % 2 as label")
    training.compare(table, estimators, parallelism=2)
    assert begun == ["FeedForward100", "HistogramBoosting9", "HistogramBoosting5", "HistogramForest"]
    assert asked == [max(2, spark.sparkContext.defaultParallelism)]
    training.compare(table, estimators)
    assert begun[4:] == ["HistogramForest", "HistogramBoosting5", "FeedForward100", "HistogramBoosting9"] and asked[1] == 1
