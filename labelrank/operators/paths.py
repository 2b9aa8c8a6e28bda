"""One fit for all settings that differ in nothing but a length: rounds, trees or epochs.

Estimators that build a model step by step have passed through every shorter model when the longest one is done.
``fitMultiple``, Spark ML's own entry for a list of settings, hands these out instead of fitting them anew.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence

from pyspark.ml import Model
from pyspark.ml.param import Param
from pyspark.sql import DataFrame, functions as F


def alike(estimator, maps: Sequence[dict], free: Sequence[str]) -> list[list[int]]:
    """Numbers of the settings that are equal but for the ``free`` parameters, together; both in order."""
    found: dict[tuple, list[int]] = {}
    for i, params in enumerate(maps):
        whole = estimator.copy(params).extractParamMap()
        key = tuple(sorted((p.name, repr(v)) for p, v in whole.items() if p.name not in free))
        found.setdefault(key, []).append(i)
    return list(found.values())


class Handed(Iterator):
    """(number, model) of every setting, for several threads. A group is fitted by the thread that asks for it first.

    Groups come by turns, so that threads fit different ones at the same time.
    """

    def __init__(self, groups: Sequence[Sequence[int]], fit: Callable[[Sequence[int]], Sequence[Model]]):
        self._groups, self._fit = groups, fit
        self._turns = iter([(g, i) for i in range(max(map(len, groups), default=0)) for g in range(len(groups)) if i < len(groups[g])])
        self._next, self._own = threading.Lock(), [threading.Lock() for _ in groups]
        self._done: list[Sequence[Model] | None] = [None] * len(groups)

    def __next__(self) -> tuple[int, Model]:
        with self._next:
            g, i = next(self._turns)
        with self._own[g]:
            if self._done[g] is None:
                self._done[g] = self._fit(self._groups[g])
        return self._groups[g][i], self._done[g][i]


class SharedPath:
    """For estimators with ``_fit_path``; ``_length`` names the parameter that counts their steps.

    Where settings share a fit that differ in more than that, ``_shared`` names all of it, and ``_fit_each`` does it.
    """

    _length: str
    _shared: Sequence[str] = ()

    @classmethod
    def shared(cls) -> Sequence[str]:
        return cls._shared or (cls._length,)

    def _fit_path(self, dataset: DataFrame, lengths: Sequence[int]) -> list[Model]:
        """The models after these numbers of steps of one fit, each as a fit of that length gives it."""
        raise NotImplementedError

    def _fit_each(self, dataset: DataFrame, each: Sequence[SharedPath]) -> list[Model]:
        return self._fit_path(dataset, [e.getOrDefault(self._length) for e in each])

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict[Param, object]]) -> Iterator[tuple[int, Model]]:
        def fit(group: Sequence[int]) -> list[Model]:
            each = [self.copy(paramMaps[i]) for i in group]
            models = each[0]._fit_each(dataset, each)
            return [e._copyValues(m) for e, m in zip(each, models)]

        return Handed(alike(self, paramMaps, self.shared()), fit)


def predict_each(models: Sequence[Model], dataset: DataFrame) -> DataFrame:
    """The rows with one column ``_p0``, ``_p1``, ... of predictions per model, of one kind each.

    Models whose settings share their work say so with a ``predict_each`` of their own.
    """
    own = getattr(type(models[0]), "predict_each", None)
    if own is not None:
        return own(models, dataset)
    out = dataset
    for i, model in enumerate(models):
        found = model.transform(out)
        out = found.select(*out.columns, F.col(model.getOrDefault("predictionCol") if model.hasParam("predictionCol") else "prediction").alias(f"_p{i}"))
    return out
