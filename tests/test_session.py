from pyspark.sql import functions as F

from labelrank import session


def test_small_tables_are_measured(spark):
    df = spark.range(2500).select("id", F.repeat(F.lit("x"), 10).alias("t"))
    assert len(session.small_rows(df)) == 2500
    assert session.small_rows(df, max_rows=2499) is None and len(session.small_rows(df, max_rows=2500)) == 2500
    assert session.small_rows(df, max_rows=10) is None
    assert session.small_rows(df, max_bytes=5000) is None
    assert session.small_rows(spark.range(3), max_bytes=1) is None
    assert session.small_rows(df.where("id < 0")) == []


def test_wide_rows_are_not_fetched(spark):
    """Rows of 100 kB: only the first look comes to the driver."""
    df = spark.range(5000).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    assert session.small_rows(df, max_bytes=10**6) is None


def test_small_side(spark):
    df = spark.range(5).select("id", F.lit(None).cast("string").alias("t"))
    joined = spark.range(3).join(session.small_side(df), "id")
    assert joined.count() == 3
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert session.small_side(df, max_rows=2) is df


def test_staged_and_spread(spark):
    df = spark.range(100).coalesce(1).select("id", (F.col("id") * 2).cast("int").alias("n"))
    stored = session.staged(df)
    assert stored.dtypes == df.dtypes and stored.exceptAll(df).count() == 0
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = df.repartition(50)
    assert session.spread(many) is many
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")
