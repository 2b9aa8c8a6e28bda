"""Ranks over whole tables without putting a table, or one hot group, into a single task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelrank.functions.hashing import HASH_BITS
from labelrank.session import ensure_checkpoint_dir, small_rows, small_side

# monotonically_increasing_id keeps the partition number above this many bits of row position.
_POSITION_BITS = 33


def sorted_positions(values: DataFrame, col: str, out: str = "code") -> DataFrame:
    """0-based position of each value in ascending order, for a table of distinct values.

    A short list is ranked on the driver. A long one is range-sorted by Spark; the position is the place
    within the sorted partition plus the sizes of the partitions before it. The sorted rows are
    checkpointed, so that a lost executor cannot change the partition borders between the two uses.
    """
    spark = values.sparkSession
    short = small_rows(values.select(col))
    if short is not None:
        ordered = sorted(r[col] for r in short)
        return spark.createDataFrame(
            [(v, i) for i, v in enumerate(ordered)],
            schema=f"{col} {values.schema[col].dataType.simpleString()}, {out} bigint",
        )
    ensure_checkpoint_dir(spark)
    placed = values.select(col).sort(col).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_id", _POSITION_BITS)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["count"]
    offsets = F.broadcast(spark.createDataFrame(starts, "_part bigint, _start bigint"))
    position = F.col("_id").bitwiseAND(F.lit(2**_POSITION_BITS - 1)) + F.col("_start")
    return placed.join(offsets, part == F.col("_part")).select(col, position.alias(out))


def rank_bits(rows: int, rows_per_bucket: int) -> int:
    """How many leading hash bits to bucket by, so that a bucket holds about ``rows_per_bucket`` rows."""
    return min(HASH_BITS, max(0, math.ceil(math.log2(max(1, rows) / rows_per_bucket))))


def hash_bucket(hashed: Column, bits: int) -> Column:
    return F.shiftright(hashed, HASH_BITS - bits)


def bucket_starts(df: DataFrame, group: str, bucket: str) -> DataFrame:
    """Rows of the group in earlier buckets: (group, bucket, start, size). One short row per bucket."""
    sizes = df.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))


def rank_in_group(
    df: DataFrame, group: str, hashed: Column, key: str, out: str = "rn", rows_per_bucket: int = 500_000
) -> DataFrame:
    """1-based rank of every row of its group by (hash, key).

    The rank is the place within (group, hash bucket) plus the size of the group's earlier buckets. The
    hash spreads rows evenly, so a group of any size is split over many tasks.
    """
    bits = rank_bits(df.count(), rows_per_bucket)
    order = [F.col("_hash"), F.col(key)]
    hashed_df = df.withColumn("_hash", hashed)
    if bits == 0:
        w = Window.partitionBy(group).orderBy(*order)
        return hashed_df.withColumn(out, F.row_number().over(w).cast("bigint")).drop("_hash")
    bucketed = hashed_df.withColumn("_bucket", hash_bucket(F.col("_hash"), bits))
    starts = small_side(
        bucket_starts(bucketed, group, "_bucket").select(
            F.col(group).alias("_g"), F.col("_bucket").alias("_b"), "start")
    )
    w = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (
        bucketed.withColumn("_place", F.row_number().over(w))
        .join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")), "left")
        .select(*df.columns, (F.col("_place") + F.col("start")).alias(out))
    )
