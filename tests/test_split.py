import pytest
from pyspark.sql import functions as F

from labelrank.operators import split


@pytest.fixture(scope="module")
def rows(spark):
    label = F.when(F.col("id") == 7, "single").when(F.col("id") % 10 == 0, "rare").otherwise("common")
    return spark.range(5000).select(F.col("id").alias("key"), label.alias("label"), (F.col("id") % 8 + 2015).alias("season"))


def test_temporal(rows):
    train = split.season_between(rows, 2015, 2017)
    assert {r.season for r in train.select("season").distinct().collect()} == {2015, 2016, 2017}
    both = split.temporal_split(rows, (2015, 2017), [2018, 2019])
    counts = {(r.part): r["count"] for r in both.groupBy("part").count().collect()}
    assert counts == {"train": train.count(), "test": split.season_in(rows, [2018, 2019]).count()}
    # The label stays in the row, so features and labels cannot fall apart.
    assert both.where("label is null").count() == 0


@pytest.mark.parametrize("rows_per_bucket", [50, 10**6])
def test_stratified_holdout_sizes(rows, rows_per_bucket):
    out = split.stratified_holdout(rows, "label", "key", rows_per_bucket=rows_per_bucket)
    got = {r.label: (r.n, r.t) for r in out.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert got == {"single": (1, 0), "rare": (500, 100), "common": (4499, 900)}


def test_same_rows_however_they_are_stored(rows):
    def picked(df, **kw):
        return {r.key for r in split.stratified_holdout(df, "label", "key", **kw).where("is_test").collect()}
    first = picked(rows)
    assert first == picked(rows.repartition(1)) == picked(rows.repartition(7), rows_per_bucket=64)


def test_missing_labels_are_a_stratum(spark):
    df = spark.range(100).select(F.col("id").alias("key"), F.when(F.col("id") < 50, "a").alias("label"))
    for per_bucket in (8, 1000):
        out = split.stratified_holdout(df, "label", "key", rows_per_bucket=per_bucket)
        assert {r.label: r.n for r in out.where("is_test").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 10, None: 10}
        folds = split.stratified_kfold(df, "label", "key", rows_per_bucket=per_bucket)
        assert folds.where("fold is null").count() == 0


def test_holdout_by_hash_needs_no_shuffle(rows):
    out = split.holdout(rows, "key")
    assert 900 < out.where("is_test").count() < 1100
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    approx = split.stratified_holdout(rows, "label", "key", exact=False)
    assert approx.where("is_test").count() == out.where("is_test").count()


def test_kfold_tests_every_row_once(rows):
    folds = split.kfold(rows, "key")
    sizes = {r.fold: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert set(sizes) == set(range(5)) and sum(sizes.values()) == 5000 and max(sizes.values()) - min(sizes.values()) < 200


@pytest.mark.parametrize("rows_per_bucket", [50, 10**6])
def test_stratified_kfold_is_even(rows, rows_per_bucket):
    folds = split.stratified_kfold(rows, "label", "key", rows_per_bucket=rows_per_bucket)
    assert folds.count() == 5000
    for label in ("rare", "common"):
        sizes = [r["count"] for r in folds.where(F.col("label") == label).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_bucketed_ranks_equal_plain_ranks(rows):
    a = split.stratified_kfold(rows, "label", "key", rows_per_bucket=50)
    b = split.stratified_kfold(rows, "label", "key")
    assert a.exceptAll(b).count() == 0
