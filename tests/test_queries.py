"""Every query on tables runs beside its SQL; queries without SQL must give rows. Those on documents: tests/llm."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from labelrank.queries import ORACLES, QUERIES
from tests.oracle import connect, mismatch

# Queries that fit many models; the checker in tests/oracle.py runs them as well.
SLOW = {
    "compare_cv", "compare_holdout", "grid_search", "grid_search_knn", "refit_best", "refit_best_knn", "score_all",
    "scores_valid", "scores_valid_others", "select_by_importance", "prep_flow_selected", "stacking", "timings", "rank_with_models",
    "model_roundtrip", "model_roundtrip_boosted",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["season", "mvp", "model", "top_k", "mvp_in_top_k"]


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_equals_sql(spark, con, sf_dir, name):
    assert mismatch(queries()[name](spark, sf_dir), con, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_gives_rows(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_no_cross_join(spark, sf_dir, name):
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
