"""Fit, time and compare models by hold-out or by k-fold cross-validation.

The driver loops over models and folds (fitting is a sequence of Spark jobs); each evaluation is one
aggregation to confusion counts, from which accuracy, error and the class report all follow.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.sql import DataFrame, functions as F

from labelrank.functions.columns import above, integer_label
from labelrank.operators import evaluate
from labelrank.operators.boosting import HistogramBoosting
from labelrank.operators.network import FeedForward
from labelrank.operators.split import holdout, kfold, stratified_holdout, stratified_kfold
from labelrank.session import at_least_cores, at_once, discard, ensure_checkpoint_dir, staged
from labelrank.sources.tables import save_model, write_reports, write_table

_COUNTS = "model string, fold int, label int, prediction int, n bigint"
_TIMES = "model string, fold int, train_time double, prediction_time double, cross_validation boolean"


@dataclass
class Comparison:
    """metrics: (model, fold, accuracy, mae, train_time, prediction_time, cross_validation); fold is null
    for a hold-out. reports: (model, fold, label, precision, recall, f1_score, support)."""

    metrics: DataFrame
    reports: DataFrame
    models: dict[str, Model] = field(default_factory=dict)

    def leaderboard(self) -> DataFrame:
        means = self.metrics.groupBy("model").agg(F.avg("accuracy").alias("accuracy"), F.avg("mae").alias("mae"))
        return evaluate.leaderboard(means)

    def mean_times(self) -> DataFrame:
        return evaluate.fold_means(self.metrics)

    def write(self, base: str) -> None:
        """Reports by model and fold, metrics and mean times as tables of their own."""
        write_reports(self.reports, f"{base}/reports", ("model", "fold"))
        write_table(self.metrics, f"{base}/metrics")
        write_table(self.mean_times(), f"{base}/times")


def timed(action: Callable):
    """Result of an action and the seconds it took."""
    start = time.perf_counter()
    result = action()
    return result, time.perf_counter() - start


def steps_in_turn(estimator: Estimator) -> float:
    """Steps that one task takes one after the other, which more cores do not shorten; 0 for fits that spread.

    A network comes before all others: its epochs are several jobs, which would queue behind those of other fits.
    """
    if isinstance(estimator, FeedForward):
        return float("inf")
    return estimator.getMaxIter() if isinstance(estimator, HistogramBoosting) else 0


def fit_all(estimators: dict[str, Estimator], train: DataFrame, parallelism: int = 4) -> dict[str, Model]:
    """Every model fitted on the same rows; so many fits at a time, since most of them cannot fill a cluster.

    As in ``compare``, there are as many as cores if these are more, and those of the most steps in one task begin first.
    """
    spark = train.sparkSession
    many = at_least_cores(spark, parallelism)
    first = estimators if many <= 1 else sorted(estimators, key=lambda n: -steps_in_turn(estimators[n]))
    found = dict(zip(first, at_once(spark, [lambda e=estimators[n]: e.fit(train) for n in first], many)))
    return {name: found[name] for name in estimators}


def fit_and_count(estimator: Estimator, train: DataFrame, test: DataFrame):
    """(model, train seconds, prediction seconds, confusion counts).

    A prediction is class 1 if it is above one half. Counting needs every prediction, so its time is that
    of scoring the whole test part.
    """
    model, train_time = timed(lambda: estimator.fit(train))
    scored = model.transform(test).select(F.col("label").cast("int").alias("label"), above("prediction").alias("prediction"))
    counts, prediction_time = timed(lambda: evaluate.confusion(scored).collect())
    return model, train_time, prediction_time, counts


def compare(
    table: DataFrame, estimators: dict[str, Estimator], key: str = "row_key", label: str = "label",
    cross_validate: bool = False, k: int = 5, stratify: bool = False, test_size: float = 0.2, seed: int = 42,
    zero_division: float = 0.0, save_to: str | None = None, final_fit: bool = False, parallelism: int = 1,
) -> Comparison:
    """Compare models on (key, label, features): hold-out, or k folds with ``cross_validate``.

    Every fold gets a fresh copy of the estimator. Boosting cuts its lineage at checkpoints, for which the
    session gets a checkpoint folder if it has none. ``final_fit`` also fits each model on all rows;
    ``save_to`` saves the final (or hold-out) models under this folder. With ``parallelism`` above 1 so many fits, or
    one for each core if these are more, run at the same time, each with fewer cores: the times are then those of a
    busy cluster. Fits with the most steps in one task begin first; those that spread over all cores fill up the rest.
    """
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    labelled = integer_label(table, label)
    if label != "label":
        labelled = labelled.withColumnRenamed(label, "label")
    labelled = labelled.withColumn("label", F.col("label").cast("double"))
    if cross_validate:
        split = stratified_kfold(labelled, "label", key, k, seed, "_part") if stratify else kfold(labelled, key, k, seed, "_part")
        parts = [(i, F.col("_part") == i) for i in range(k)]
    else:
        split = (
            stratified_holdout(labelled, "label", key, test_size, seed, "_part")
            if stratify else holdout(labelled, key, test_size, seed, "_part")
        )
        parts = [(None, F.col("_part"))]
    split = staged(split, "split")  # stored before the first fit, so that no model's time contains the split
    counts, times, models = [], [], {}
    try:
        def one(estimator: Estimator, is_test) -> tuple:
            return fit_and_count(estimator.copy(), split.where(~is_test).drop("_part"), split.where(is_test).drop("_part"))

        many = at_least_cores(spark, parallelism)
        first = estimators if many <= 1 else sorted(estimators, key=lambda n: -steps_in_turn(estimators[n]))
        runs = [(name, fold, is_test) for name in first for fold, is_test in parts]
        done = at_once(spark, [lambda n=name, t=is_test: one(estimators[n], t) for name, _, is_test in runs], many)
        for (name, fold, _), (model, train_time, prediction_time, seen) in zip(runs, done):
            times.append((name, fold, train_time, prediction_time, cross_validate))
            counts += [(name, fold, r["label"], r["prediction"], r["n"]) for r in seen]
            models[name] = model
        if final_fit:
            whole = split.drop("_part")
            models = dict(zip(estimators, at_once(spark, [lambda e=e: e.copy().fit(whole) for e in estimators.values()], many)))
        if save_to:
            for name, model in models.items():
                save_model(PipelineModel([model]), save_to, name)
    finally:
        discard(split)
    confusion = spark.createDataFrame(counts, _COUNTS)
    by = ["model", "fold"]
    scores = evaluate.metrics_from_confusion(confusion, by).withColumnsRenamed({"model": "_m", "fold": "_f"})
    metrics = (
        spark.createDataFrame(times, _TIMES)
        .join(scores, (F.col("model") == F.col("_m")) & F.col("fold").eqNullSafe(F.col("_f")), "left")
        .select(*by, "accuracy", "mae", "train_time", "prediction_time", "cross_validation")
    )
    return Comparison(metrics, evaluate.report_from_confusion(confusion, by, zero_division), models)


def cross_validate_model(table: DataFrame, estimator: Estimator, key: str = "row_key", k: int = 5, **kw) -> tuple[float, DataFrame]:
    """Mean accuracy over the folds, and the class reports per fold."""
    found = compare(table, {"model": estimator}, key, cross_validate=True, k=k, **kw)
    return found.metrics.agg(F.avg("accuracy")).first()[0], found.reports
