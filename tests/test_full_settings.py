"""The registered queries ask for the operators' whole settings."""

import pytest

from labelrank.operators import prep
from labelrank.plans import registry
from labelrank.queries import QUERIES, modelling, preparing


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["select_by_importance", "prep_flow_selected"])
def test_forest_selection_has_all_trees(spark, sf_dir, monkeypatch, name):
    def forest(**kw):
        raise Asked(kw["numTrees"], kw["maxDepth"])

    monkeypatch.setattr(prep, "HistogramForest", forest)
    with pytest.raises(Asked) as found:
        getattr(preparing, name)(spark, sf_dir)
    assert found.value.args == (1000, 0)


ROUNDS = {"BoostedTreesWeighted": 1000, "BoostedTreesDeep": 500, "BoostedTreesLeafy": 200}


def rounds(estimators):
    return {n: m.getMaxIter() for n, m in estimators.items() if n.startswith("Boosted")}


@pytest.mark.parametrize("name, cross_validate", [("compare_cv", True), ("timings", True), ("compare_holdout", False)])
def test_comparisons_have_all_models(spark, sf_dir, monkeypatch, name, cross_validate):
    def compare(table, estimators, cross_validate=False, **kw):
        raise Asked(set(estimators), rounds(estimators), cross_validate, "weight" in table.columns)

    monkeypatch.setattr(modelling.training, "compare", compare)
    with pytest.raises(Asked) as found:
        getattr(modelling, name)(spark, sf_dir)
    assert found.value.args == (set(registry.models(registry.Shape(64, 1, 1))), ROUNDS, cross_validate, True)


@pytest.mark.parametrize("name", ["grid_search", "refit_best"])
def test_searches_have_all_models(spark, sf_dir, monkeypatch, name):
    def grid_search(table, searches, **kw):
        raise Asked({n: len(grid) for n, (_, grid) in searches.items()})

    monkeypatch.setattr(modelling.tuning, "grid_search", grid_search)
    with pytest.raises(Asked) as found:
        getattr(modelling, name)(spark, sf_dir)
    assert found.value.args == ({n: len(grid) for n, (_, grid) in registry.tuned_models(registry.Shape(64, 1, 1)).items()},)


class Fake:
    def __init__(self, name, fitted):
        self.name, self.fitted = name, fitted

    def fit(self, table):
        assert "weight" in table.columns
        self.fitted.append(self.name)
        return self.name


@pytest.mark.parametrize("names, sink, steps", [
    (["score_all"], "score_all", 1), (["scores_valid", "scores_valid_others"], "score_all", 2), (["rank_with_models"], "rank_seasons", 1),
    (["train_gbt_a", "train_gbt_b", "train_gbt_c"], "score_all", 3),
])
def test_fits_have_all_models_and_rounds(spark, sf_dir, monkeypatch, names, sink, steps):
    fitted, asked, real = [], [], registry.models

    def models(shape, **kw):
        found = real(shape, **kw)
        asked.append(rounds(found))
        return {n: Fake(n, fitted) for n in found}

    def scored(models, *args):
        raise Asked(models)

    monkeypatch.setattr(modelling.registry, "models", models)
    monkeypatch.setattr(modelling.scoring, sink, scored)
    for name in names:
        with pytest.raises(Asked):
            QUERIES[name](spark, sf_dir)
    every = set(ROUNDS) if steps == 3 else set(real(registry.Shape(64, 1, 1)))
    assert set(fitted) == every and len(fitted) == len(every) and asked == [ROUNDS] * steps
