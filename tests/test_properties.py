"""Properties that hold for any table."""

import numpy as np
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from labelrank.operators import groups, prep, rank, split, stats

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
numbers = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6).map(lambda v: round(v, 3))), min_size=1, max_size=40)
texts = st.lists(st.one_of(st.none(), st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=4)), min_size=1, max_size=30)


@few
@given(values=numbers.filter(lambda vs: any(v is not None for v in vs)))
def test_cap_and_scale(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")
    cap = prep.fit_cap(df, ["x"])
    capped = cap.apply(df)
    lo, hi = cap.bounds["x"]
    known = [r.x for r in capped.orderBy("id").collect()]
    assert [v is None for v in known] == [v is None for v in values]
    assert all(lo <= v <= hi for v in known if v is not None)
    assert capped.exceptAll(cap.apply(capped)).count() == 0
    assert cap.scale().ranges == prep.fit_scale(capped, ["x"]).ranges
    scaled = [r.x for r in cap.scale().apply(capped).collect() if r.x is not None]
    assert all(-1e-9 <= v <= 1 + 1e-9 for v in scaled)
    want = np.quantile([v for v in values if v is not None], [0.25, 0.75])
    got, _ = stats.quantiles(df, ["x"], [0.25, 0.75], max_values=3, bins=4)
    assert np.allclose(got["x"], want)


@few
@given(values=texts)
def test_codes_are_dense_and_ordered(spark, values):
    df = spark.createDataFrame([(v, v) for v in values], "t string, u string")
    codes = {r.u: r.t for r in prep.fit_codes(df, ["t"]).apply(df).collect()}
    known = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
    assert {v: c for v, c in codes.items() if v is not None} == {v: i for i, v in enumerate(known)}
    assert codes.get(None, -1) == -1


@few
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.sampled_from([None, 0.0, 0.5, 1.0])), min_size=1, max_size=40), k=st.integers(1, 6))
def test_winners_and_top_k(spark, rows, k):
    df = spark.createDataFrame([(g, v, f"p{i % 5}", i) for i, (g, v) in enumerate(rows)], "season int, award_share double, player string, row_key bigint")
    won = {r.row_key for r in groups.label_winners(df.repartition(3)).where("mvp_award").collect()}
    best = {}
    for g, v in rows:
        if v is not None:
            best[g] = max(v, best.get(g, v))
    assert won == {i for i, (g, v) in enumerate(rows) if v is not None and v == best[g]}
    top = rank.top_k(df, k, ["season"], "award_share").groupBy("season").count().collect()
    sizes = {g: sum(1 for h, _ in rows if h == g) for g in {g for g, _ in rows}}
    assert {r.season: r["count"] for r in top} == {g: min(k, n) for g, n in sizes.items()}


@few
@given(n=st.integers(1, 200), k=st.integers(2, 6), seed=st.integers(0, 5))
def test_folds_part_the_rows(spark, n, k, seed):
    df = spark.range(n).select(F.col("id").alias("key"), (F.col("id") % 3).alias("label"))
    for folds in (split.kfold(df, "key", k, seed), split.stratified_kfold(df, "label", "key", k, seed, rows_per_bucket=16)):
        assert folds.select("key").distinct().count() == n and folds.where(~F.col("fold").between(0, k - 1)).count() == 0
