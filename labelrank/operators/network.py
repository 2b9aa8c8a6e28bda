"""Feed-forward network for 0/1 labels, trained in mini-batches, as a Spark ML estimator.

Hidden layers are rectified, with inverted dropout where asked for; the output is one sigmoid unit under cross-entropy.
The rows lie in the memory of the tasks of a barrier stage, so many tasks as the table needs. A mini-batch is a set of
rows from all tasks: each task adds up the gradients of its own rows, the tasks exchange the sums and take the same
step. Which batch a row joins in an epoch, and which units drop out for it, come from a hash of its key, so a run
repeats bit for bit with the same number of tasks, whatever the order of the rows; with another number, sums round
differently.

After every ``epochsPerJob`` epochs weights and moments go to the driver (some numbers per weight, none per row) and the
next job starts from them: a lost executor costs the epochs of one job. A step is one exchange between the tasks, so
the size of a batch should grow with the table. A table that fits in one task needs no exchange.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from labelrank.operators.boosting import CELLS, _mixed
from labelrank.operators.paths import SharedPath
from labelrank.operators.saving import SavedModel
from labelrank.session import discard, staged

_U = np.uint64
#: Step sizes of the optimizers, their decays and what is added to a divisor: the usual defaults.
RATES = {"adam": 0.001, "sgd": 0.01, "rmsprop": 0.001}
_FIRST, _SECOND, _RMS, _TINY = 0.9, 0.999, 0.9, 1e-7
#: Mini-batches whose rows and dropouts are laid out together.
_AHEAD = 256


def weights(layers: list[int]) -> int:
    return sum((a + 1) * b for a, b in zip(layers, layers[1:]))


def _unpack(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the matrix and the offsets of each layer."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def start(layers: list[int], seed: int) -> np.ndarray:
    """Uniform weights that keep the variance from layer to layer, offsets zero."""
    rng, flat = np.random.default_rng(seed), np.zeros(weights(layers))
    for w, _ in _unpack(flat, layers):
        bound = np.sqrt(6 / sum(w.shape))
        w[:] = rng.uniform(-bound, bound, w.shape)
    return flat


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.abs(z)
    np.exp(np.negative(e, out=e), out=e)
    return np.where(z >= 0, 1, e) / (1 + e)


def scores(flat: np.ndarray, layers: list[int], x: np.ndarray) -> np.ndarray:
    *hidden, (w, b) = _unpack(flat, layers)
    for v, c in hidden:
        x = np.maximum(x @ v + c, 0)
    return _sigmoid((x @ w + b)[:, 0])


def kept(key: np.ndarray, units: int, share: float, salt: int) -> np.ndarray | float:
    """Rows x units: 0 for a unit that drops out for this row, else what makes up for the others."""
    if share <= 0:
        return 1.0
    unit = _mixed(np.arange(1, units + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) ^ _U(salt % 2**63))
    # the upper 53 bits of the hash are the chance
    stays = _mixed(key[:, None] ^ unit[None, :]) >= _U(math.ceil(share * 2**53) << 11)
    return stays / (1 - share)


def gradients(flat: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, masks: list) -> np.ndarray:
    """Sum over the rows of the gradient of the cross-entropy."""
    out = np.empty_like(flat)
    _gradients(_unpack(flat, layers), _unpack(out, layers), x, y, masks)
    return out


def _gradients(parts: list, own: list, x: np.ndarray, y: np.ndarray, masks: list) -> None:
    """The same from views of the weights into views of the result."""
    seen = [x]
    for (w, b), mask in zip(parts[:-1], masks):
        z = np.dot(seen[-1], w)
        z += b
        np.maximum(z, 0, out=z)
        if not isinstance(mask, float):
            z *= mask
        seen.append(z)
    w, b = parts[-1]
    delta = (_sigmoid((np.dot(seen[-1], w) + b)[:, 0]) - y)[:, None]
    for i in range(len(parts) - 1, -1, -1):
        np.dot(seen[i].T, delta, out=own[i][0])
        np.add.reduce(delta, axis=0, out=own[i][1])
        if i:
            delta = np.dot(delta, parts[i][0].T)
            delta *= np.sign(seen[i])  # 1 where a unit is above 0, which it is never below
            if not isinstance(masks[i - 1], float):
                delta *= masks[i - 1]


def step(state: np.ndarray, g: np.ndarray, number: int, optimizer: str, rate: float, spare: np.ndarray | None = None) -> None:
    """One step in place; ``state`` is (weights, first moments, second moments), ``number`` counts from 1.

    ``spare`` is room for two more numbers a weight.
    """
    w, first, second = state
    if optimizer == "sgd":
        w -= rate * g
    elif optimizer == "rmsprop":
        second += (1 - _RMS) * (g * g - second)
        w -= rate * g / (np.sqrt(second) + _TINY)
    else:
        moved, under = spare if spare is not None else np.empty((2, len(g)))
        np.subtract(g, first, out=moved)
        moved *= 1 - _FIRST
        first += moved
        np.multiply(g, g, out=moved)
        moved -= second
        moved *= 1 - _SECOND
        second += moved
        np.sqrt(second, out=under)
        under += _TINY
        np.multiply(first, rate * np.sqrt(1 - _SECOND**number) / (1 - _FIRST**number), out=moved)
        moved /= under
        w -= moved


class _NetParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasSeed):
    layers = Param(Params._dummy(), "layers", "units of every layer, from the features to the one output", TypeConverters.toListInt)
    dropout = Param(Params._dummy(), "dropout", "share of units that drop out, per hidden layer; empty for none", TypeConverters.toListFloat)
    optimizer = Param(Params._dummy(), "optimizer", "adam, sgd or rmsprop", TypeConverters.toString)
    stepSize = Param(Params._dummy(), "stepSize", "step size, 0 for the optimizer's own", TypeConverters.toFloat)
    batchSize = Param(Params._dummy(), "batchSize", "rows of a mini-batch, on average", TypeConverters.toInt)
    keyCol = Param(Params._dummy(), "keyCol", "column that tells rows apart; empty for their content", TypeConverters.toString)
    tasks = Param(Params._dummy(), "tasks", "tasks that hold the rows: 0 for as many as they need, and never more than there are cores", TypeConverters.toInt)
    epochsPerJob = Param(Params._dummy(), "epochsPerJob", "epochs between two copies of the state", TypeConverters.toInt)
    scoreCol = Param(Params._dummy(), "scoreCol", "probability of label 1", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(
            dropout=[], optimizer="adam", stepSize=0.0, batchSize=32, maxIter=100, seed=42, keyCol="", tasks=0, epochsPerJob=20, scoreCol="score")

    def getLayers(self) -> list[int]:
        return self.getOrDefault(self.layers)


class FeedForward(SharedPath, Estimator, _NetParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on rows whose label is 0 or 1 (rows with a null label do not count); there must be one at least, and no
    feature may be missing. Without ``keyCol`` equal rows join the same batch; with null or equal keys, so do theirs."""

    _length = "maxIter"

    @keyword_only
    def __init__(self, *, layers, featuresCol="features", labelCol="label", predictionCol="prediction", dropout=(), optimizer="adam",
                 stepSize=0.0, batchSize=32, maxIter=100, seed=42, keyCol="", tasks=0, epochsPerJob=20, scoreCol="score"):
        super().__init__()
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> FeedForwardModel:
        return self._copyValues(self._fit_path(dataset, [self.getMaxIter()])[0])

    def _fit_path(self, dataset: DataFrame, lengths: Sequence[int]) -> list[FeedForwardModel]:
        o, spark = self.getOrDefault, dataset.sparkSession
        layers, optimizer, seed = o("layers"), o("optimizer"), o("seed") % 2**31
        dropout = o("dropout") or [0.0] * (len(layers) - 2)
        if len(layers) < 2 or layers[-1] != 1 or len(dropout) != len(layers) - 2 or optimizer not in RATES:
            raise ValueError("layers end in one unit, dropout has a share per hidden layer, and the optimizer is adam, sgd or rmsprop")
        rate, epochs, width = o("stepSize") or RATES[optimizer], max(lengths), layers[0]
        columns = [vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")]
        keyed = [F.col(o("keyCol")).alias("k")] if o("keyCol") else []
        rows = dataset.select(*columns, *keyed).where("y is not null")
        rows = staged(rows.select("x", "y", F.xxhash64(*(["k"] if keyed else ["x", "y"])).alias("key")), "network")
        try:
            good = (F.size("x") == width) & ~F.exists("x", lambda v: F.isnan(v) | v.isNull()) & F.col("y").isin(0.0, 1.0)
            facts = rows.agg(F.count("y").alias("n"), F.bool_and(good).alias("good")).first()
            if not facts["n"] or not facts["good"]:
                raise ValueError(f"there must be rows with a label of 0 or 1, and vectors of {width} numbers")
            n = facts["n"]
            batches_of_epoch = -(-n // o("batchSize"))
            tasks = max(1, min(o("tasks") or -(-n * width // CELLS), spark.sparkContext.defaultParallelism))
            dealt = rows.repartition(tasks, "key")
            state = np.stack([start(layers, seed), *np.zeros((2, weights(layers)))])
            passed = {0: state[0].tolist()}
            stops = sorted({*range(0, epochs, o("epochsPerJob")), *lengths})
            for first, stop in zip(stops, stops[1:]):
                span = range(first, stop)
                held = spark.sparkContext.broadcast(state)

                def run(batches: Iterator[pa.RecordBatch], span=span, held=held) -> Iterator[pa.RecordBatch]:
                    context = BarrierTaskContext.get()
                    many = len(context.getTaskInfos())

                    def add_up(own: np.ndarray) -> np.ndarray:
                        if many == 1:
                            return own
                        parts = context.allGather(base64.b64encode(own.tobytes()).decode())
                        return sum(np.frombuffer(base64.b64decode(p)) for p in parts)

                    xs, ys, keys = [np.zeros((0, width))], [np.zeros(0)], [np.zeros(0, np.uint64)]
                    for batch in batches:
                        xs.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                        ys.append(batch.column(1).to_numpy(zero_copy_only=False))
                        keys.append(batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
                    x, y, key = map(np.concatenate, (xs, ys, keys))
                    order = np.lexsort((*x.T, y, key))  # the same order however the rows arrived
                    x, y, key = x[order], y[order], key[order]
                    own, found = held.value.copy(), np.zeros(held.value.shape[1] + 1)
                    spare, mean = np.empty((2, held.value.shape[1])), np.empty(held.value.shape[1])
                    parts, sums = _unpack(own[0], layers), _unpack(found[:-1], layers)
                    for epoch in span:
                        salt = _mixed(np.array([seed * 1_000_003 + epoch], _U))[0]
                        joins = ((_mixed(key ^ salt) >> _U(11)).astype(np.float64) / 2**53 * batches_of_epoch).astype(np.int64)
                        by_batch = np.argsort(joins, kind="stable")
                        edges = np.searchsorted(joins[by_batch], np.arange(batches_of_epoch + 1))
                        for lo in range(0, batches_of_epoch, _AHEAD):
                            hi = min(batches_of_epoch, lo + _AHEAD)
                            r = by_batch[edges[lo] : edges[hi]]
                            xs, ys = x[r], y[r]
                            masks = [kept(key[r], layers[i + 1], s, int(salt) + i + 1) for i, s in enumerate(dropout)]
                            for b in range(lo, hi):
                                at = slice(edges[b] - edges[lo], edges[b + 1] - edges[lo])
                                _gradients(parts, sums, xs[at], ys[at], [m if isinstance(m, float) else m[at] for m in masks])
                                found[-1] = edges[b + 1] - edges[b]
                                total = add_up(found)
                                if total[-1]:
                                    step(own, np.divide(total[:-1], total[-1], out=mean), epoch * batches_of_epoch + b + 1, optimizer, rate, spare)
                    if context.partitionId() == 0:
                        yield pa.RecordBatch.from_pydict({"state": pa.array([own.tobytes()], pa.binary())})

                state = np.frombuffer(bytes(dealt.mapInArrow(run, "state binary", barrier=True).collect()[0]["state"])).reshape(3, -1).copy()
                held.destroy()
                passed[stop] = state[0].tolist()
        finally:
            discard(rows)
        return [FeedForwardModel(passed[n]) for n in lengths]


class FeedForwardModel(Model, _NetParams, SavedModel):
    def __init__(self, weights: list[float]):
        super().__init__()
        self.weights = weights

    def _fitted(self) -> dict:
        return {"weights": self.weights}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held, layers = dataset.sparkSession.sparkContext.broadcast(np.array(self.weights)), self.getLayers()

        @F.pandas_udf("double")
        def probability(vectors: pd.Series) -> pd.Series:
            return pd.Series(scores(held.value, layers, np.stack(vectors.to_numpy())) if len(vectors) else np.zeros(0))

        score, label = self.getOrDefault(self.scoreCol), self.getPredictionCol()
        scored = dataset.withColumn(score, probability(vector_to_array(self.getFeaturesCol())))
        return scored.withColumn(label, (F.col(score) > 0.5).cast("double"))
