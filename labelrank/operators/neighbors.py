"""Exact k-nearest-neighbour vote under a Minkowski metric, as a Spark ML estimator.

A training table whose size is checked to be small is broadcast, and every batch of queries is compared
with it. A larger one is never paired with all queries:

* a few training rows serve as pivots, and each training row belongs to the cell of its nearest pivot;
* the k-th nearest row of a query's own cell and the k-th nearest pivot bound its k-th neighbour, and the triangle
  inequality then rules out the cells that cannot hold one, so a query is sent to the remaining cells only;
* cells are cut by key hash into blocks of bounded size, on both sides, so a cell that holds a third of
  all rows is many tasks; a block returns at most k rows per query;
* where the cells rule out less than half of the pairs, as in many dimensions, all rows are one cell.

Nothing is approximate: a cell is left out only if all of its rows are provably farther away. So is a pair within a
block: its Euclidean distance, from products of matrices, bounds the wanted one from below.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from labelrank.functions.hashing import key_hash
from labelrank.operators.paths import Handed, alike
from labelrank.operators.saving import SavedModel
from labelrank.session import small_rows, staged

_SLAB_CELLS = 4_000_000
#: Queries and training rows of one product of matrices.
_TILE = 512, 4096
#: Blocks that a side is cut into at most, as long as a block's vectors stay below so many bytes.
_BLOCKS, _BLOCK_BYTES = 16, 1 << 26
#: Parameters that do not change which rows are near, only how many of them vote and how.
VOTE = ("k", "weights")


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values]) if len(values) else np.empty((0, 0))


def _distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    return _distances_of(np.abs(a[:, None, :] - b[None, :, :]), p)


def _distances_of(gap: np.ndarray, p: float) -> np.ndarray:
    # Small whole exponents by multiplication, which is much faster than a general power.
    powered = {1.0: lambda: gap, 2.0: lambda: gap * gap, 3.0: lambda: gap * gap * gap}.get(p, lambda: gap**p)()
    return powered.sum(axis=-1) ** (1.0 / p)


def _slabs(rows: int, other: int, width: int) -> Iterator[slice]:
    """Slices of the queries that keep the working array of one comparison small."""
    size = max(1, _SLAB_CELLS // max(1, other * width))
    return (slice(i, i + size) for i in range(0, rows, size))


def _firsts(q: np.ndarray, t: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k lowest (distance, training row) of each query, in this order, from hits in any order."""
    order = np.lexsort((t, d, q))
    q, t, d = q[order], t[order], d[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], t[keep], d[keep]


def _nearest_plain(queries: np.ndarray, train: np.ndarray, k: int, p: float) -> tuple[np.ndarray, ...]:
    """``_nearest`` from the distances of all pairs."""
    found = []
    for part in _slabs(len(queries), len(train), queries.shape[1]):
        dist = _distances(queries[part], train, p)
        limit = np.partition(dist, min(k, len(train)) - 1, axis=1)[:, min(k, len(train)) - 1]
        q, t = np.nonzero(dist <= limit[:, None])
        q, t, d = _firsts(q, t, dist[q, t], k)
        found.append((q + part.start, t, d))
    return tuple(np.concatenate(c) for c in zip(*found))


def _paired(a: np.ndarray, b: np.ndarray, q: np.ndarray, t: np.ndarray, p: float) -> np.ndarray:
    """Distances of the pairs (q, t), the same numbers as in ``_distances``."""
    some = max(1, _SLAB_CELLS // 64 // max(1, a.shape[1]))
    return np.concatenate([np.zeros(0)] + [
        _distances_of(np.abs(a[q[i : i + some]] - b[t[i : i + some]]), p) for i in range(0, len(q), some)])


def _nearest(queries: np.ndarray, train: np.ndarray, k: int, p: float) -> tuple[np.ndarray, ...]:
    """(query, train, distance) of the k nearest training rows of each query.

    Training rows come sorted by key, so that an earlier row wins a tie. Euclidean distances, from products of
    matrices, bound those of the metric from below: the k-th best pair so far rules out nearly all others, and only
    the rest is measured. The margin covers rounding in the products.
    """
    n, width = len(train), queries.shape[1]
    middle = train.mean(axis=0)
    a, b = queries - middle, train - middle
    norms = [np.einsum("ij,ij->i", v, v) for v in (a, b)]
    largest = sum(v.max() for v in norms)
    if n <= 4 * k or p < 1 or not np.isfinite(largest) or largest > 1e200 or largest < 1e-200:
        return _nearest_plain(queries, train, k, p)
    # ||x||_2 times this is at most ||x||_p
    shrink = min(1.0, width ** (1 / p - 0.5))
    a, b, norms = a / largest**0.5, b / largest**0.5, [v / largest for v in norms]
    left = np.concatenate([-2 * a, norms[0][:, None], np.ones((len(a), 1))], axis=1)
    right = np.concatenate([b, np.ones((n, 1)), norms[1][:, None]], axis=1).T
    exact, rough = ((left.astype(t), right.astype(t), 4 * (width + 8) * np.finfo(t).eps) for t in (np.float64, np.float32))
    work = {t: np.empty(_TILE[0] * _TILE[1], t) for t in (np.float64, np.float32)}
    found = []
    for lo in range(0, len(queries), _TILE[0]):
        part = queries[lo : lo + _TILE[0]]
        row, best, (x, y, margin) = np.arange(len(part)), None, exact
        for at in range(0, n, _TILE[1]):
            some = min(_TILE[1], n - at)
            squares = work[x.dtype.type][: len(part) * some].reshape(len(part), some)
            np.matmul(x[lo : lo + _TILE[0]], y[:, at : at + _TILE[1]], out=squares)
            if best is None:
                # some near rows, k of them at least: the k-th of their distances bounds that of all rows
                close = min(some, 4 * k)
                t = np.argpartition(squares, close - 1, axis=1)[:, :close].ravel()
                dist = np.sort(_paired(part, train, np.repeat(row, close), t, p).reshape(-1, close), axis=1)
                bound = dist[:, k - 1] if close >= k else np.full(len(part), np.inf)
                best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            limit = (bound / shrink) ** 2 / largest * (1 + 1e-9)
            near = squares <= (limit + margin).astype(squares.dtype)[:, None]
            q, t = np.divmod(np.flatnonzero(near), some)
            if len(q):
                t += at
                d = _paired(part, train, q, t, p)
                keep = d <= bound[q]
                q, t, d = q[keep], t[keep], d[keep]
                best = _firsts(*(np.concatenate(c) for c in zip(best, (q, t, d))), k)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(part)) == k)
                last = np.searchsorted(best[0], full, "right") - 1
                bound[full] = np.minimum(bound[full], best[2][last])
            if not at and rough[2] < np.median(limit) / 50:
                # half the work per product where its wider margin lets hardly more pairs through
                x, y, margin = rough
        found.append((best[0] + lo, *best[1:]))
    return tuple(np.concatenate(c) for c in zip(*found))


class _NeighborParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "neighbours that vote", TypeConverters.toInt)
    p = Param(Params._dummy(), "p", "exponent of the metric", TypeConverters.toFloat)
    weights = Param(Params._dummy(), "weights", "'distance' or 'uniform'", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "unique row key", TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "vote share of label 1", TypeConverters.toString)
    broadcastRows = Param(Params._dummy(), "broadcastRows", "largest broadcast training table", TypeConverters.toInt)
    blockRows = Param(Params._dummy(), "blockRows", "rows per block of a cell", TypeConverters.toInt)
    pivots = Param(Params._dummy(), "pivots", "number of cells", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(k=3, p=3.0, weights="distance", keyCol="row_key", scoreCol="score",
                         broadcastRows=20_000, blockRows=10_000, pivots=256)

    def _get(self, name: str):
        return self.getOrDefault(getattr(self, name))


class NearestNeighbors(Estimator, _NeighborParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", keyCol="row_key",
                 scoreCol="score", k=3, p=3.0, weights="distance", broadcastRows=20_000, blockRows=10_000, pivots=256):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NearestNeighborsModel:
        train = dataset.select(
            F.col(self._get("keyCol")).alias("train"),
            F.col(self.getLabelCol()).cast("double").alias("label"),
            vector_to_array(self.getFeaturesCol()).alias("x"),
        )
        return self._copyValues(NearestNeighborsModel(staged(train, "neighbours")))

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]) -> Iterator[tuple[int, NearestNeighborsModel]]:
        """Settings of the vote share one copy of the training table."""
        def fit(group: Sequence[int]) -> list[NearestNeighborsModel]:
            each = [self.copy(paramMaps[i]) for i in group]
            first = each[0]._fit(dataset)
            return [e._copyValues(NearestNeighborsModel(first.train)) for e in each]

        return Handed(alike(self, paramMaps, VOTE), fit)


class NearestNeighborsModel(Model, _NeighborParams, SavedModel):
    """The fitted model is the training table itself, in a copy of its own."""

    def __init__(self, train: DataFrame):
        super().__init__()
        self.train = train

    def _save_parts(self, path: str) -> None:
        self.train.write.parquet(f"{path}/train")

    @classmethod
    def _restore(cls, fitted: dict, path: str, spark) -> NearestNeighborsModel:
        return cls(spark.read.parquet(f"{path}/train"))

    def neighbors(self, dataset: DataFrame) -> DataFrame:
        """(query, train, label, dist): up to k neighbours of every query row."""
        queries = dataset.select(
            F.col(self._get("keyCol")).alias("query"), vector_to_array(self.getFeaturesCol()).alias("x"))
        limit = self._get("broadcastRows")
        short = small_rows(self.train, limit) if limit else None
        return self._against_small(queries, short) if short is not None else self._against_cells(queries)

    def _hits_schema(self, queries: DataFrame) -> str:
        q, t = queries.schema["query"].dataType, self.train.schema["train"].dataType
        return f"query {q.simpleString()}, train {t.simpleString()}, label double, dist double"

    def _against_small(self, queries: DataFrame, short: list[Row]) -> DataFrame:
        if not short:
            raise ValueError("no training rows")
        k, p = self._get("k"), self._get("p")
        short.sort(key=lambda r: r["train"])
        keys, labels = np.array([r["train"] for r in short]), np.array([r["label"] for r in short])
        shared = queries.sparkSession.sparkContext.broadcast((keys, labels, _matrix([r["x"] for r in short])))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, labels, points = shared.value
            for pdf in batches:
                if len(pdf):
                    q, t, d = _nearest(_matrix(pdf["x"]), points, k, p)
                    yield pd.DataFrame({"query": pdf["query"].to_numpy()[q], "train": keys[t], "label": labels[t], "dist": d})

        return queries.mapInPandas(search, self._hits_schema(queries))

    def _against_cells(self, queries: DataFrame) -> DataFrame:
        k, p = self._get("k"), self._get("p")
        spark = queries.sparkSession
        sample = self.train.orderBy(key_hash(0, "train"), "train").limit(max(k, self._get("pivots"))).select("x").collect()
        pivots = spark.sparkContext.broadcast(_matrix([r["x"] for r in sample]))

        @F.pandas_udf("cell int, dist double")
        def home(x: pd.Series) -> pd.DataFrame:
            points, cells, dists = _matrix(x), [], []
            for part in _slabs(len(points), len(pivots.value), points.shape[1]):
                d = _distances(points[part], pivots.value, p)
                cells.append(d.argmin(axis=1))
                dists.append(d.min(axis=1))
            return pd.DataFrame({"cell": np.concatenate(cells), "dist": np.concatenate(dists)})

        homed = self.train.withColumn("home", home("x"))
        stats = {
            r["cell"]: r
            for r in homed.groupBy("home.cell").agg(
                F.count(F.lit(1)).alias("n"), F.min("home.dist").alias("lo"), F.max("home.dist").alias("hi")).collect()
        }
        used = np.array(sorted(stats))
        inner, outer = (np.array([stats[c][e] for c in used]) for e in ("lo", "hi"))

        @F.pandas_udf("array<int>")
        def reachable(x: pd.Series, home: pd.Series, known: pd.Series) -> pd.Series:
            points, own, within, out = _matrix(x), home.to_numpy(), known.to_numpy(), []
            for part in _slabs(len(points), len(pivots.value), points.shape[1]):
                d = _distances(points[part], pivots.value, p)
                # Pivots are training rows, so the k-th nearest one bounds the k-th neighbour from above, as does the k-th of the own cell.
                bound = np.fmin(np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.inf, within[part])[:, None]
                to = d[:, used]
                least = np.maximum.reduce([to - outer, inner - to, (to - d.min(axis=1, keepdims=True)) / 2])
                # The margin covers rounding in the distances.
                near = (least <= bound * (1 + 1e-9) + 1e-12) & (used != own[part, None])
                out.extend(used[row].astype(np.int32) for row in near)
            return pd.Series(out)

        held = {c: r["n"] for c, r in stats.items()}
        width = max(1, pivots.value.shape[1])

        def search(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            if q.empty or t.empty:
                return pd.DataFrame({"query": [], "train": [], "label": [], "dist": []})
            t = t.sort_values("train")
            qi, ti, d = _nearest(_matrix(q["x"]), _matrix(t["x"]), k, p)
            return pd.DataFrame({
                "query": q["query"].to_numpy()[qi], "train": t["train"].to_numpy()[ti],
                "label": t["label"].to_numpy()[ti], "dist": d,
            })

        def hits(sent: DataFrame, train: DataFrame, arriving: dict, held: dict) -> DataFrame:
            """Up to k rows for each query and block that it is sent to, by cell."""
            def cuts(rows: dict) -> Column:
                # A row is copied to every block of the other side, so blocks grow with the table as far as a task can hold them.
                size = max(self._get("blockRows"), min(-(-sum(rows.values()) // _BLOCKS), _BLOCK_BYTES // (8 * width)))
                return F.create_map(*[F.lit(int(v)) for c in held for v in (c, max(1, -(-rows.get(c, 0) // size)))])

            train_cuts, query_cuts = cuts(held), cuts(arriving)

            def place(df: DataFrame, key: str, own: Column, other: Column, names: tuple[str, str]) -> DataFrame:
                """Each row has one block on its own side, and visits all blocks of the other side of its cell."""
                visits = F.explode(F.sequence(F.lit(0), other[F.col("cell")] - 1))
                return df.withColumn(names[0], F.pmod(key_hash(1, key), own[F.col("cell")]).cast("int")).withColumn(names[1], visits)

            left = place(sent, "query", query_cuts, train_cuts, ("qb", "tb"))
            right = place(train, "train", train_cuts, query_cuts, ("tb", "qb"))
            blocks = ["cell", "qb", "tb"]
            return left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInPandas(search, self._hits_schema(queries))

        def counted(sent: DataFrame) -> dict:
            return {r["cell"]: r["count"] for r in sent.groupBy("cell").count().collect()}

        def first(found: DataFrame) -> DataFrame:
            return found.withColumn("_rn", F.row_number().over(Window.partitionBy("query").orderBy("dist", "train"))).where(F.col("_rn") <= k)

        # Each query's own cell comes first: its k-th neighbour there rules out most of the others.
        asked = staged(queries.select("query", "x", home("x").getField("cell").alias("cell")), "queries")
        at_home, homed = counted(asked), homed.select("train", "label", "x", "home.cell")
        near = staged(first(hits(asked, homed, at_home, held)), "near")
        bounds = near.where(F.col("_rn") == k).select(F.col("query").alias("_query"), F.col("dist").alias("_bound"))
        known = asked.join(bounds, F.col("query") == F.col("_query"), "left")
        sent = known.select("query", "x", F.explode(reachable("x", "cell", "_bound")).alias("cell"))
        arriving, total, rows = counted(sent), sum(at_home.values()), sum(held.values())
        if 2 * sum(held[c] * (arriving.get(c, 0) + at_home.get(c, 0)) for c in held) > rows * total:
            # Cells that rule out less than half of the pairs are not worth a copy of a query for each: one cell holds all.
            one, cell = F.lit(int(used[0])).alias("cell"), int(used[0])
            found = hits(asked.select("query", "x", one), self.train.select("train", "label", "x", one), {cell: total}, {cell: rows})
        else:
            found = near.drop("_rn").unionByName(hits(sent, homed, arriving, held))
        return first(found).drop("_rn")

    def votes(self, dataset: DataFrame) -> DataFrame:
        """(query, label, vote). A neighbour at distance 0 leaves no vote to farther ones."""
        hits = self.neighbors(dataset)
        if self._get("weights") == "uniform":
            weighted = hits.withColumn("w", F.lit(1.0))
        else:
            exact = F.min("dist").over(Window.partitionBy("query")) == 0
            weighted = hits.withColumn("exact", exact).withColumn(
                "w", F.when(F.col("exact"), (F.col("dist") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("dist")))
            )
        return weighted.groupBy("query", "label").agg(F.sum("w").alias("vote"))

    def elected(self, dataset: DataFrame) -> DataFrame:
        """(query, prediction, vote, score): the label with most votes, the smaller label on a tie."""
        # Rounding makes equal votes equal whatever the order of summation was.
        vote = F.round("vote", 6)
        ones = F.sum(F.when(F.col("label") == 1, F.col("vote")).otherwise(0.0))
        return self.votes(dataset).groupBy("query").agg(
            F.min_by("label", F.struct(-vote, F.col("label"))).alias("prediction"),
            F.max(vote).alias("vote"),
            F.try_divide(ones, F.sum("vote")).alias("score"),
        )

    def _keyed(self, dataset: DataFrame) -> DataFrame:
        key = self._get("keyCol")
        absent = F.raise_error(F.lit(f"null in the row key {key}")).cast(dataset.schema[key].dataType)
        return dataset.withColumn(key, F.coalesce(F.col(key), absent))

    @staticmethod
    def predict_each(models: Sequence[NearestNeighborsModel], dataset: DataFrame) -> DataFrame:
        """The rows with a prediction per model: one search for the largest k; all models have one training table."""
        widest = max(models, key=lambda m: m._get("k"))
        dataset = widest._keyed(dataset)
        near = widest.neighbors(dataset).withColumn("_rn", F.row_number().over(Window.partitionBy("query").orderBy("dist", "train")))
        near = near.withColumn("_exact", F.min("dist").over(Window.partitionBy("query")) == 0)
        by_distance = F.when(F.col("_exact"), (F.col("dist") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("dist")))
        votes = near.groupBy("query", "label").agg(*[
            F.sum(F.when(F.col("_rn") <= m._get("k"), F.lit(1.0) if m._get("weights") == "uniform" else by_distance)).alias(f"_v{i}")
            for i, m in enumerate(models)])
        won = votes.groupBy(F.col("query").alias("_query")).agg(*[
            F.min_by("label", F.when(F.col(f"_v{i}").isNotNull(), F.struct(-F.round(f"_v{i}", 6), F.col("label")))).alias(f"_p{i}")
            for i in range(len(models))])
        return dataset.join(won, F.col(widest._get("keyCol")) == F.col("_query")).drop("_query")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, dataset = self._get("keyCol"), self._keyed(dataset)
        won = self.elected(dataset).select(
            F.col("query").alias("_query"), F.col("prediction").alias(self.getPredictionCol()),
            F.col("score").alias(self._get("scoreCol")),
        )
        return dataset.join(won, F.col(key) == F.col("_query")).drop("_query")
