"""Train/test splits and folds, as columns or filters on the row. Reproducible by seed and row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelrank.functions.hashing import key_hash, key_uniform
from labelrank.operators.ordering import bucket_starts, hash_bucket, rank_bits, rank_in_group
from labelrank.session import small_side


def season_between(df: DataFrame, first: int, last: int, season: str = "season") -> DataFrame:
    """Rows of the seasons first..last, both included."""
    return df.where(F.col(season).between(first, last))


def season_in(df: DataFrame, seasons: Sequence[int], season: str = "season") -> DataFrame:
    return df.where(F.col(season).isin(*seasons))


def temporal_split(
    df: DataFrame, train: tuple[int, int], test: Sequence[int], season: str = "season", out: str = "part"
) -> DataFrame:
    """Mark training seasons and test seasons; rows of other seasons are left out."""
    part = F.when(F.col(season).between(*train), "train").when(F.col(season).isin(*test), "test")
    return df.withColumn(out, part).where(F.col(out).isNotNull())


def holdout(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Plain hold-out by key hash. No shuffle; the sizes are close to the share, not exact."""
    return df.withColumn(out, key_uniform(seed, key) < test_size)


def _test_rows(n: Column, test_size: float) -> Column:
    return F.round(F.lit(test_size) * n).cast("bigint")


def stratified_holdout(
    df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42, out: str = "is_test",
    exact: bool = True, rows_per_bucket: int = 500_000,
) -> DataFrame:
    """Hold-out with the same share of every label: round(share * rows of the label) rows.

    The test rows are the smallest by (hash, key) of their label, so all that is needed per label is the
    last pair still in. Bucket counts by leading hash bits find the one bucket it lies in; only that
    bucket is ordered. The rows themselves are then marked by a projection, without a shuffle.
    ``exact=False`` marks by hash alone.
    """
    if not exact:
        return holdout(df, key, test_size, seed, out)
    hashed = key_hash(seed, key)
    slim = df.select(F.col(label).alias("_g"), F.col(key).alias("_k"), hashed.alias("_h"))
    bits = rank_bits(slim.count(), rows_per_bucket)
    slim = slim.withColumn("_b", hash_bucket(F.col("_h"), bits) if bits else F.lit(0))

    starts = bucket_starts(slim, "_g", "_b")
    whole = Window.partitionBy("_g")
    edge = (
        starts.withColumn("need", _test_rows(F.sum("size").over(whole), test_size))
        .where((F.col("start") < F.col("need")) & (F.col("need") <= F.col("start") + F.col("size")))
        .select(F.col("_g").alias("_eg"), F.col("_b").alias("_eb"), (F.col("need") - F.col("start")).alias("take"))
    )
    on_edge = slim.join(small_side(edge), F.col("_g").eqNullSafe(F.col("_eg")) & (F.col("_b") == F.col("_eb")))
    last_in = Window.partitionBy("_g").orderBy("_h", "_k")
    cutoff = (
        on_edge.withColumn("_rn", F.row_number().over(last_in))
        .where(F.col("_rn") == F.col("take"))
        .select(F.col("_g").alias("_cg"), F.col("_h").alias("_ch"), F.col("_k").alias("_ck"))
    )
    joined = df.withColumn("_h", hashed).join(small_side(cutoff), F.col(label).eqNullSafe(F.col("_cg")), "left")
    inside = (F.col("_h") < F.col("_ch")) | ((F.col("_h") == F.col("_ch")) & (F.col(key) <= F.col("_ck")))
    return joined.select(*df.columns, F.coalesce(inside, F.lit(False)).alias(out))


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Shuffled folds 0..k-1 by key hash: every row is tested once. No shuffle; sizes are near-equal."""
    return df.withColumn(out, F.pmod(key_hash(seed, key), F.lit(k)).cast("int"))


def stratified_kfold(
    df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, out: str = "fold",
    rows_per_bucket: int = 500_000,
) -> DataFrame:
    """Folds that share every label evenly: sizes per label differ by one row at most."""
    ranked = rank_in_group(df, label, key_hash(seed, key), key, "_rn", rows_per_bucket)
    return ranked.select(*df.columns, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int").alias(out))


