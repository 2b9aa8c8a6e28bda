"""Gaussian naive Bayes with variance smoothing, as a Spark ML estimator.

Training is one aggregation (count, mean, variance of every feature per label); scoring is a JVM
expression over the feature array.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from labelrank.operators.saving import SavedModel

MAX_CLASSES = 1_000
UNROLLED = 64


class _BayesParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    smoothing = Param(
        Params._dummy(), "smoothing", "share of the largest feature variance added to all variances",
        TypeConverters.toFloat,
    )
    scoreCol = Param(Params._dummy(), "scoreCol", "posterior of the largest label", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        # Fixed value: variance smoothing.
        self._setDefault(smoothing=9.748288799431293e-07, scoreCol="score")


class GaussianNaiveBayes(Estimator, _BayesParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 smoothing=9.748288799431293e-07, scoreCol="score"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> GaussianNaiveBayesModel:
        x, label = F.col(self.getFeaturesCol()), F.col(self.getLabelCol()).cast("double")
        rows = (
            dataset.select(x.alias("x"), label.alias("label"))
            .where("label is not null")
            .groupBy("label")
            .agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("x")).alias("s"))
            .limit(MAX_CLASSES + 1)
            .collect()
        )
        if not rows or len(rows) > MAX_CLASSES:
            raise ValueError(f"the label must have 1 to {MAX_CLASSES} classes")
        rows.sort(key=lambda r: r["label"])
        n = np.array([float(r["s"]["count"]) for r in rows])
        means = np.array([r["s"]["mean"].toArray() for r in rows])
        # Summarizer divides by n - 1; the model wants the population variance.
        var = np.array([r["s"]["variance"].toArray() * (m - 1) / m for r, m in zip(rows, n)])
        share = (n / n.sum())[:, None]
        overall = (share * means).sum(axis=0)
        total_var = (share * (var + (means - overall) ** 2)).sum(axis=0)
        var = var + self.getOrDefault(self.smoothing) * total_var.max()
        if (var <= 0).any():
            raise ValueError("a feature without variance needs smoothing and another feature that varies")
        model = GaussianNaiveBayesModel(
            [r["label"] for r in rows], np.log(share[:, 0]).tolist(), means.tolist(), var.tolist()
        )
        return self._copyValues(model)


class GaussianNaiveBayesModel(Model, _BayesParams, SavedModel):
    def __init__(self, labels, log_priors, means, variances):
        super().__init__()
        self.labels, self.log_priors, self.means, self.variances = labels, log_priors, means, variances

    def _fitted(self) -> dict:
        return {n: getattr(self, n) for n in ("labels", "log_priors", "means", "variances")}

    def log_likelihoods(self) -> Column:
        """Array with the joint log-likelihood of every label, in label order, from the array ``_x``.

        For a modest number of terms the sum is written out, so that it is compiled with the query.
        """
        x, parts = F.col("_x"), []
        for prior, mean, var in zip(self.log_priors, self.means, self.variances):
            const = prior - 0.5 * sum(math.log(2 * math.pi * v) for v in var)
            if len(mean) * len(self.labels) <= UNROLLED:
                squares = sum((x[i] - m) * (x[i] - m) / v for i, (m, v) in enumerate(zip(mean, var)))
            else:
                centre, spread = (F.array(*[F.lit(float(v)) for v in a]) for a in (mean, var))
                terms = F.zip_with(F.zip_with(x, centre, lambda a, b: (a - b) * (a - b)), spread, lambda d, v: d / v)
                squares = F.aggregate(terms, F.lit(0.0), lambda s, d: s + d)
            parts.append(F.lit(const) - 0.5 * squares)
        return F.array(*parts)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        labels = F.array(*[F.lit(float(v)) for v in self.labels])
        scored = dataset.withColumn("_x", vector_to_array(self.getFeaturesCol())).withColumn(
            "_ll", self.log_likelihoods()).withColumn("_top", F.array_max("_ll"))
        posterior = F.exp(F.element_at("_ll", -1) - F.col("_top")) / F.aggregate(
            "_ll", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("_top"))
        )
        if len(self.labels) == 1:
            posterior = F.lit(1.0 if self.labels[0] > 0 else 0.0)
        best = F.element_at(labels, F.array_position("_ll", F.col("_top")).cast("int"))
        return scored.select(
            *dataset.columns, best.alias(self.getPredictionCol()), posterior.alias(self.getOrDefault(self.scoreCol))
        )
