"""Scoring rows with fitted models, ours or from outside, into one long score table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Model
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from labelrank.operators.rank import ranked_lists
from labelrank.operators.split import season_in


def add_score(scored: DataFrame, out: str = "score") -> DataFrame:
    """Score of the positive class: its probability, or the margin of a model that has none."""
    if out in scored.columns:
        return scored
    source = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.withColumn(out, vector_to_array(source)[1])


def score_all(models: dict[str, Model], df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ids..., model, score, prediction): every row scored by every model in one pass over the rows.

    Columns of ``df`` that have the name of a model's output are set aside, so that they are not taken for it.
    """
    aside = {c: f"_own_{c}" for c in ("score", "prediction", "probability", "rawPrediction") if c in df.columns}
    out, cells = df.withColumnsRenamed(aside), []
    for i, (name, model) in enumerate(models.items()):
        scored = add_score(model.transform(out))
        out = scored.select(
            *out.columns, F.col("score").cast("double").alias(f"_s{i}"), F.col("prediction").cast("int").alias(f"_p{i}"))
        cells.append(F.struct(
            F.lit(name).alias("model"), F.col(f"_s{i}").alias("score"), F.col(f"_p{i}").alias("prediction")))
    kept = [F.col(aside.get(c, c)).alias(c) for c in ids]
    return out.select(F.struct(*kept).alias("i"), F.explode(F.array(*cells)).alias("c")).select(
        *[F.col(f"i.{c}") for c in ids], "c.model", "c.score", "c.prediction")


def score_external(
    df: DataFrame, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int,
    features: str = "features", unit_axis: bool = False, batch_size: int = 1024, out: str = "score",
) -> DataFrame:
    """Score with a network trained elsewhere.

    ``make_predict`` runs once per worker process, loads the model and returns a function from a batch of
    32-bit feature rows, shape (n, width) or with ``unit_axis`` (n, width, 1), to n scores.
    """
    shape = [width, 1] if unit_axis else [width]
    predict = predict_batch_udf(
        make_predict, return_type=T.FloatType(), batch_size=batch_size, input_tensor_shapes=[shape])
    col = F.col(features)
    if not isinstance(df.schema[features].dataType, T.ArrayType):
        col = vector_to_array(col, "float32")
    return df.withColumn(out, predict(col.cast("array<float>")).cast("double"))


def rank_seasons(
    models: dict[str, Model], table: DataFrame, seasons: Sequence[int], k: int = 10, label: str = "label",
    season: str = "season", player: str = "player", key: str = "row_key", match: str = "name", which: str = "first",
) -> DataFrame:
    """Per season and model the k best candidates, the true winner and whether it is among them.

    ``table`` has the feature vector, the label, and the season, player and row key.
    """
    rows = season_in(table, seasons, season)
    scores = score_all(models, rows, [season, player, key])
    winners = rows.where(F.col(label) == 1).select(season, player, key)
    return ranked_lists(scores, winners, k, season, "model", player, key, "score", match, which)
