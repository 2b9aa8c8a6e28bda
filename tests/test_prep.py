import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelrank import functions as fn
from labelrank.operators import ordering, prep, stats
from labelrank.plans import preparation


def column(df, name):
    return [r[name] for r in df.collect()]


def test_fill_mean_mode_and_ties(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "b"), (2, None, "a"), (3, float("nan"), "a"), (4, 4.0, "b"), (5, 4.0, None)], "id int, x double, t string")
    fill = prep.fit_fill(df, ["x"], ["t"])
    assert fill.numbers == {"x": 3.0} and fill.texts == {"t": "a"}
    out = fill.apply(df).orderBy("id")
    assert column(out, "x") == [1.0, 3.0, 3.0, 4.0, 4.0]
    assert column(out, "t") == ["b", "a", "a", "b", "a"]
    assert prep.fit_texts(df, ["t"])[0] == {"t": "a"}


def test_fill_refuses_an_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    with pytest.raises(ValueError, match="y"):
        prep.fit_fill(df)


def test_fit_on_uses_only_those_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 100.0), (2, None)], "season int, x double")
    assert prep.fit_fill(df, ["x"], [], fit_on=F.col("season") == 1).numbers == {"x": 2.0}
    assert prep.fit_scale(df, ["x"], fit_on=F.col("season") == 1).ranges == {"x": (1.0, 3.0)}


def test_codes_order_missing_and_unknown(spark):
    df = spark.createDataFrame([("b",), ("Z",), ("é",), (None,), ("a",), ("a",)], "t string")
    codes = prep.fit_codes(df, ["t"])
    assert dict(codes.apply(df).dtypes)["t"] == "bigint"
    assert {r.t0: r.t for r in codes.apply(df.withColumn("t0", F.col("t"))).collect()} == {"Z": 0, "a": 1, "b": 2, "é": 3, None: -1}
    other = spark.createDataFrame([("x",)], "t string")
    assert column(codes.apply(other), "t") == [-1]


@pytest.mark.parametrize("parts", [1, 7])
def test_codes_of_a_long_dictionary(spark, monkeypatch, parts):
    """The path for dictionaries that do not fit a driver gives the same codes."""
    df = spark.range(0, 500, 1, parts).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("t")).withColumn("u", F.col("t"))
    monkeypatch.setattr(prep, "small_rows", lambda *a: None)
    monkeypatch.setattr(ordering, "small_rows", lambda *a: None)
    monkeypatch.setattr(prep, "small_side", lambda d: d)
    modes, codes = prep.fit_texts(df, ["t"])
    assert modes == {"t": "v0"}
    assert dict(codes.apply(df).dtypes)["t"] == "bigint"
    got = {r.u: r.t for r in codes.apply(df).collect()}
    assert got == {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(500)))}


def test_one_hot_drops_the_first(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, None)], "id int, t string")
    out = prep.fit_one_hot(df, ["t"]).apply(df).orderBy("id")
    assert out.columns == ["id", "t_b", "t_c"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 0), (0, 0), (0, 1), (0, 0)]
    with pytest.raises(ValueError):
        prep.fit_one_hot(df, ["t"], max_columns=2)


def test_cap(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),)], "x double")
    cap = prep.fit_cap(df)
    assert cap.bounds == {"x": (-2.75, 9.25)}
    assert column(cap.apply(df), "x") == [1.0, 2.0, 3.0, 9.25, None, None]
    assert cap.scale().ranges == {"x": (1.0, 9.25)}
    flat = spark.createDataFrame([(5.0,)] * 9 + [(99.0,)], "x double")
    assert set(column(prep.fit_cap(flat).apply(flat), "x")) == {5.0}
    labelled = df.withColumn("y", F.lit(1))
    assert list(prep.fit_cap(labelled, label="y").bounds) == ["x"]


def test_cap_approximately(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    lo, hi = prep.fit_cap(df, exact=False).bounds["x"]
    assert abs(lo - (249.75 - 1.5 * 499.5)) < 3 and abs(hi - (749.25 + 1.5 * 499.5)) < 3


def test_scale(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (5.0, None)], "x double, flat double")
    out = prep.fit_scale(df, ["x", "flat"]).apply(df)
    assert column(out, "x") == [0.0, 0.5, 1.0]
    assert column(out, "flat") == [0.0, 0.0, None]


@pytest.mark.parametrize("max_values", [5, 40, 10**6])
def test_quantiles_are_exact_with_ties(spark, max_values):
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(size=700), np.full(900, 0.25), rng.integers(0, 4, 400)])
    df = spark.createDataFrame([(float(v), int(v * 10)) for v in a], "x double, i int").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found, ranges = stats.quantiles(df, ["x", "i"], probs, max_values=max_values, bins=8)
    ints = np.array([int(v * 10) for v in a])
    assert np.allclose(found["x"], np.quantile(a, probs)) and np.allclose(found["i"], np.quantile(ints, probs))
    assert ranges["x"] == (a.min(), a.max())


def test_quantiles_of_odd_columns(spark):
    """Very uneven values, neighbouring doubles, an empty column; infinity is refused."""
    uneven = [10.0 ** (i / 7) for i in range(300)] + [-(10.0**12)]
    tight = [1.0 + (i % 3) * 2.0**-52 for i in range(301)]
    df = spark.createDataFrame([(a, b, None) for a, b in zip(uneven, tight)], "a double, b double, c double")
    probs = [0.01, 0.25, 0.5, 0.75]
    found, _ = stats.quantiles(df, ["a", "b", "c"], probs, max_values=2, bins=4)
    assert np.allclose(found["a"], np.quantile(uneven, probs), rtol=1e-12)
    assert found["b"] == list(np.quantile(tight, probs)) and found["c"] == [None] * 4
    with pytest.raises(ValueError, match="a"):
        stats.quantiles(spark.createDataFrame([(1.0,), (float("inf"),)], "a double"), ["a"], probs)


def test_thresholds(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (None,), (float("nan"),), (1.0,)], "x double")
    assert column(df.select(fn.above("x").alias("y")), "y") == [0, 1, 0, 0, 1]
    assert column(fn.integer_label(df, "x"), "x") == [0, 1, 0, 0, 1]
    ints = spark.createDataFrame([(2,)], "x int")
    assert column(fn.integer_label(ints, "x"), "x") == [2]


def test_columns_by_type_and_projection(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True)], "a int, b double, c string, d boolean")
    assert fn.numeric_columns(df) == ["a", "b"] and fn.string_columns(df) == ["c"]
    assert fn.drop_columns(df, "a").columns == ["b", "c", "d"]
    assert fn.drop_columns(df, "zz", strict=False).columns == df.columns
    with pytest.raises(ValueError):
        fn.drop_columns(df, "zz")
    with pytest.raises(ValueError):
        fn.keep_columns(df, ["a", "zz"])
    assert dict(fn.to_float32(df, ["b"]).dtypes)["b"] == "float"
    nan = spark.createDataFrame([(float("nan"), 1)], "x double, y int")
    assert [tuple(r) for r in fn.null_nans(nan).collect()] == [(None, 1)]


def test_minutes_and_noise(spark):
    df = spark.createDataFrame([(1, 9.0), (2, 10.0), (3, None)], "id int, mp double")
    assert sorted(column(prep.min_minutes(df), "id")) == [2, 3]
    cols = [f"c{i}" for i in range(6)]
    base = spark.range(200).select("id", *[F.lit(0.0).alias(c) for c in cols])
    a = prep.add_noise(base, cols, "id").orderBy("id").toPandas()[cols].to_numpy()
    b = prep.add_noise(base.repartition(5), cols, "id").orderBy("id").toPandas()[cols].to_numpy()
    assert (a == b).all() and a.min() >= -0.1 and a.max() < 0.1 and abs(a.mean()) < 0.01
    assert len(np.unique(a)) == a.size


def test_assemble_refuses_missing_values(spark):
    df = spark.createDataFrame([(1.0, None)], "x double, y double")
    with pytest.raises(Exception, match="null while assembling"):
        prep.assemble(df, ["x", "y"]).collect()


def test_importances(spark):
    df = spark.range(400).select(
        "id", (F.col("id") % 2).cast("int").alias("label"), ((F.col("id") % 2) * 3.0).alias("useful"), F.lit(1.0).alias("flat"))
    found = prep.feature_importances(df, ["useful", "flat"], "label", num_trees=5, max_depth=3)
    assert math.isclose(sum(found.values()), 1.0)
    assert prep.select_by_importance(df, found, ["label", "id"]).columns == ["useful", "label", "id"]


def test_prepare_keeps_rows_and_ids(spark):
    rows = [(1, 2000, "a", 0.9, "x", 10.0), (2, 2000, "b", None, None, 20.0), (3, 2001, "c", 0.5, "y", None), (4, None, "d", 0.1, "y", 30.0)]
    df = spark.createDataFrame(rows, "key int, season int, player string, award_share double, pos string, pts double")
    done = preparation.prepare(df, ids=["key"])
    out = {r.key: r for r in done.table.collect()}
    assert done.features == ["pos", "pts"]
    assert {k: r.mvp_award for k, r in out.items()} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0}
    assert {k: (r.season, r.player) for k, r in out.items()} == {1: (2000, "a"), 2: (2000, "b"), 3: (2001, "c"), 4: (None, "d")}
    assert {k: r.pts for k, r in out.items()} == {1: 0.0, 2: 0.5, 3: 0.5, 4: 1.0}
    assert {k: r.pos for k, r in out.items()} == {1: 0.0, 2: 1.0, 3: 1.0, 4: 1.0}
