"""Classifiers by name, configured from the width and the class balance of the training data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from labelrank.operators.bayes import GaussianNaiveBayes
from labelrank.operators.boosting import HistogramBoosting
from labelrank.operators.forest import HistogramForest
from labelrank.operators.neighbors import NearestNeighbors
from labelrank.operators.network import FeedForward
from labelrank.plans.stacking import Stacking

SEED = 42


@dataclass(frozen=True)
class Shape:
    """What the settings of a model depend on."""

    features: int
    rows: int
    positives: int

    def reg(self, c: float) -> float:
        """Spark averages the loss over the rows, so a penalty factor C corresponds to 1 / (C * rows)."""
        return 1.0 / (c * max(1, self.rows))


def shape_of(table: DataFrame, features: int, label: str = "label") -> Shape:
    row = table.agg(F.count(label).alias("n"), F.sum(F.col(label).cast("int")).alias("s")).first()
    return Shape(features, row["n"], row["s"] or 0)


def add_weight(table: DataFrame, shape: Shape, label: str = "label", out: str = "weight") -> DataFrame:
    """Positive rows weigh rows / positives, the others 1."""
    return table.withColumn(out, F.when(F.col(label) == 1, shape.rows / max(1, shape.positives)).otherwise(1.0))


def models(
    shape: Shape, key: str = "row_key", boosting_rounds: int | None = None, weight: str | None = None
) -> dict[str, Estimator]:
    """The models to compare. ``boosting_rounds`` replaces the rounds of the boosted models; nothing else depends on it.

    ``weight`` names the row weight for the model that balances classes; see ``add_weight``.
    """
    # Depths, rounds, rates and layer sizes of the compared models.
    balanced = {} if weight is None else {"weightCol": weight}
    f = shape.features
    return {
        "RandomForest": HistogramForest(maxDepth=10, numTrees=1000, minSplit=10, minInstancesPerNode=1, subset="sqrt", seed=SEED),
        "BoostedTreesWeighted": HistogramBoosting(
            maxDepth=10, maxIter=boosting_rounds or 1000, stepSize=0.1, minGain=0.2, subsamplingRate=0.9, columnRate=0.9, l1=0.5, l2=1.5,
            minHessian=1.0, seed=SEED, **balanced),
        "BoostedTreesDeep": HistogramBoosting(grow="level", maxDepth=8, maxIter=boosting_rounds or 500, stepSize=0.1, l2=5.0, seed=SEED),
        "BoostedTreesLeafy": HistogramBoosting(
            grow="leaf", maxLeaves=31, maxDepth=10, maxIter=boosting_rounds or 200, stepSize=0.1, l1=0.0, l2=0.0, minHessian=0.001,
            minInstancesPerNode=20, seed=SEED),
        "KNN": NearestNeighbors(k=3, p=3.0, weights="distance", keyCol=key),
        "SVM": LinearSVC(regParam=shape.reg(1.0), maxIter=100, standardization=False),
        "LogisticL1": LogisticRegression(
            elasticNetParam=1.0, regParam=shape.reg(1.0), maxIter=100, standardization=False),
        "GaussianNB": GaussianNaiveBayes(),
        "ANN": FeedForward(layers=[f, 50, 50, 50, 1], dropout=[0.0, 0.3, 0.0], maxIter=100, batchSize=32, keyCol=key, seed=SEED),
    }


def stacking(shape: Shape, key: str = "row_key", boosting_rounds: int | None = None, folds: int = 5) -> Stacking:
    """Forest and two boosted models under a logistic head."""
    all_models = tuned_models(shape, key, boosting_rounds, with_stacking=False)
    bases = [all_models[n][0] for n in ("RandomForest", "BoostedTreesA", "BoostedTreesB")]
    head = LogisticRegression(regParam=shape.reg(1.0), maxIter=100, standardization=False)
    return Stacking(bases, head, folds=folds, key=key)


def tuned_models(
    shape: Shape, key: str = "row_key", boosting_rounds: int | None = None, with_stacking: bool = True
) -> dict[str, tuple[Estimator, list]]:
    """Default models, each with the grid of settings to search; ``boosting_rounds`` as for ``models``."""
    # Grids and layer sizes. Depth 0 is an unlimited one.
    forest = HistogramForest(numTrees=100, maxDepth=0, seed=SEED)
    boost_a = HistogramBoosting(maxDepth=6, maxIter=boosting_rounds or 100, stepSize=0.3, l2=1.0, minHessian=1.0, seed=SEED)
    boost_b = HistogramBoosting(grow="level", maxDepth=6, maxIter=boosting_rounds or 1000, stepSize=0.03, l2=3.0, seed=SEED + 1)
    knn = NearestNeighbors(k=5, p=2.0, weights="uniform", keyCol=key)
    svm = LinearSVC(regParam=shape.reg(1.0), maxIter=100, standardization=False)
    logistic = LogisticRegression(regParam=shape.reg(1.0), maxIter=100, standardization=False)
    layers = [shape.features, 128, 64, 64, 32, 64, 32, 16, 1]
    ann = FeedForward(layers=layers, dropout=[0.5] * 7, keyCol=key, seed=SEED)

    def boost_grid(model: HistogramBoosting) -> list:
        return (
            ParamGridBuilder().addGrid(model.maxIter, [50, 100, 200])
            .addGrid(model.stepSize, [0.01, 0.1, 0.2]).build()
        )

    found = {
        "RandomForest": (
            forest,
            ParamGridBuilder().addGrid(forest.numTrees, [50, 100, 200])
            .addGrid(forest.maxDepth, [0, 10, 20]).build(),
        ),
        "BoostedTreesA": (boost_a, boost_grid(boost_a)),
        "BoostedTreesB": (boost_b, boost_grid(boost_b)),
        "KNN": (
            knn, ParamGridBuilder().addGrid(knn.k, [3, 5, 7]).addGrid(knn.weights, ["uniform", "distance"]).build(),
        ),
        "SVM": (svm, ParamGridBuilder().addGrid(svm.regParam, [shape.reg(c) for c in (0.1, 1, 10)]).build()),
        "GaussianNB": (GaussianNaiveBayes(), [{}]),
        "LogisticRegression": (
            logistic, ParamGridBuilder().addGrid(logistic.regParam, [shape.reg(c) for c in (0.1, 1, 10)]).build(),
        ),
        "ANN": (
            ann,
            ParamGridBuilder().addGrid(ann.maxIter, [10, 20]).addGrid(ann.batchSize, [32, 64])
            .addGrid(ann.optimizer, ["adam", "sgd", "rmsprop"]).build(),
        ),
    }
    if with_stacking:
        found["Stacking"] = (stacking(shape, key, boosting_rounds), [{}])
    return found
