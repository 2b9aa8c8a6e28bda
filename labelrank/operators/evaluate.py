"""Metrics of labelled predictions. Everything starts from confusion counts, which are tiny."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def accuracy_mae(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Share of right predictions and mean absolute error, per group of rows."""
    l, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return df.groupBy(*by).agg(F.avg((l == p).cast("double")).alias("accuracy"), F.avg(F.abs(l - p)).alias("mae"))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """(n, positives, weight) with weight = n / positives, the weight of a positive row."""
    l = F.col(label).cast("int")
    return df.agg(F.count(l).alias("n"), F.sum(l).alias("positives")).withColumn(
        "weight", F.try_divide(F.col("n").cast("double"), F.col("positives"))
    )


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Rows per (label, prediction): the only pass over the predictions that a report needs."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _class_name(df: DataFrame, col: str) -> Column:
    """Class as text; a whole number is written without a fraction."""
    if isinstance(df.schema[col].dataType, T.NumericType):
        whole = F.col(col).cast("double") == F.floor(F.col(col).cast("double"))
        return F.when(whole, F.col(col).cast("bigint").cast("string")).otherwise(F.col(col).cast("string"))
    return F.col(col).cast("string")


def report_from_confusion(counts: DataFrame, by: Sequence[str] = (), zero_division: float = 0.0) -> DataFrame:
    """Per-class precision, recall, f1 and support, then accuracy, macro avg and weighted avg.

    ``counts`` is (by..., label, prediction, n). The accuracy row carries its number in all four columns.
    A ratio without a denominator is ``zero_division``.
    """
    l, p = _class_name(counts, "label"), _class_name(counts, "prediction")
    zero = F.lit(0).cast("bigint")

    def side(name: Column, tp: Column, support: Column, predicted: Column) -> Column:
        return F.struct(name.alias("label"), tp.alias("tp"), support.alias("support"), predicted.alias("predicted"))

    sides = F.array(
        side(l, F.when(l == p, F.col("n")).otherwise(zero), F.col("n"), zero), side(p, zero, zero, F.col("n"))
    )
    per_class = (
        counts.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, F.col("s.label").alias("label"))
        .agg(*[F.sum(f"s.{c}").cast("double").alias(c) for c in ("tp", "support", "predicted")])
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(float(zero_division)))

    rated = per_class.select(
        *by, "label", "tp", "support",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1_score"),
    )
    scores = ("precision", "recall", "f1_score")
    rows = F.array(F.col("label"), F.lit("accuracy"), F.lit("macro avg"), F.lit("weighted avg"))
    summed = (
        rated.select("*", F.posexplode(rows).alias("kind", "line"))
        .groupBy(*by, "kind", "line")
        .agg(
            F.sum("tp").alias("tp"), F.sum("support").alias("total"),
            *[F.avg(c).alias(f"{c}_avg") for c in scores],
            *[F.sum(F.col(c) * F.col("support")).alias(f"{c}_sum") for c in scores],
        )
    )
    share = F.try_divide(F.col("tp"), F.col("total"))

    def value(c: str) -> Column:
        weighted = F.try_divide(F.col(f"{c}_sum"), F.col("total"))
        return F.when(F.col("kind") == 1, share).when(F.col("kind") == 3, weighted).otherwise(F.col(f"{c}_avg"))

    return summed.select(
        *by, F.col("line").alias("label"), *[value(c).alias(c) for c in scores],
        F.when(F.col("kind") == 1, share).otherwise(F.col("total")).alias("support"),
    )


def class_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = (),
    zero_division: float = 0.0,
) -> DataFrame:
    return report_from_confusion(confusion(df, label, prediction, by), by, zero_division)


def metrics_from_confusion(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy and mean absolute error per group, from confusion counts."""
    l, p, n = F.col("label").cast("double"), F.col("prediction").cast("double"), F.col("n")
    return counts.groupBy(*by).agg(
        (F.sum(F.when(l == p, n).otherwise(0)) / F.sum(n)).alias("accuracy"),
        (F.sum(F.abs(l - p) * n) / F.sum(n)).alias("mae"),
    )


def fold_means(metrics: DataFrame, cols: Sequence[str] = ("accuracy", "train_time", "prediction_time")) -> DataFrame:
    """Mean over the folds of each model."""
    return metrics.groupBy("model").agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def leaderboard(metrics: DataFrame, tie: str = "model") -> DataFrame:
    """Models that have an accuracy, best first, ranked from 1. One row per model, so one task is enough."""
    order = Window.orderBy(F.desc("accuracy"), F.asc(tie))
    return metrics.where(F.col("accuracy").isNotNull()).withColumn("rank", F.row_number().over(order))


def best_params(candidates: DataFrame) -> DataFrame:
    """Per model the candidate with the highest mean accuracy; the first one wins a tie.

    ``candidates`` is (model, candidate, params, mean_accuracy), candidates numbered in grid order.
    """
    return candidates.groupBy("model").agg(
        F.max_by("params", F.struct(F.col("mean_accuracy"), -F.col("candidate"))).alias("params"),
        F.max("mean_accuracy").alias("mean_accuracy"),
    )


def append_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, tables)
