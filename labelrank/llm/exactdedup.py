"""Exact duplicates by progressive refinement, in DataFrame functions only.

1. Texts are grouped by their length in bytes; a length that occurs once settles its text.
2. Of the rest the first characters are hashed; a pair (length, prefix hash) that occurs once settles its text.
3. Only what is left is read to its end: rows are grouped by length, prefix hash and SHA-256 of the whole text.

Between the steps only counts of narrow keys are shuffled, with partial sums in every task, so a group of copies
with a third of all rows is no hot task. The keys that occur more than once come back as a bitmap of fixed size,
so no text is shuffled. A false hit in it (all rows, once there are many more such keys than bits) means that a
text is read to its end without need, and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from labelrank.llm.tables import flagged, written

#: Characters of the prefix that is hashed in the second step.
PREFIX = 128


def _survivors(rows: DataFrame, prefix: int) -> DataFrame:
    """``rows`` with ``_n``, ``_p`` and ``_full``: length, prefix hash and SHA-256, null where a text is alone before."""
    sized = rows.withColumn("_n", F.octet_length("_text"))
    lengths = sized.groupBy("_n").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    first = flagged(sized, F.xxhash64("_n"), lengths.select(F.xxhash64("_n").alias("h")))
    begun = first.withColumn("_p", F.when(F.col("_hit"), F.xxhash64("_n", F.left("_text", F.lit(prefix))))).drop("_hit")
    prefixes = begun.where("_p is not null").groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    second = flagged(begun, F.coalesce("_p", F.lit(0).cast("bigint")), prefixes.select(F.col("_p").alias("h")))
    hit = F.col("_hit") & F.col("_p").isNotNull()
    return second.withColumn("_full", F.when(hit, F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))).drop("_hit")


def _rows(docs: DataFrame, text: str, normalise: Callable[[Column], Column] | None, **more: Column) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select((normalise(body) if normalise else body).alias("_text"), *[c.alias(n) for n, c in more.items()])


def groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None,
    normalise: Callable[[Column], Column] | None = None, prefix: int = PREFIX,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, carry) of every row of ``docs``, which is read three times.

    Texts are equal when identical after ``normalise`` (default: as they are); a null text is the empty text. Of
    equal texts the row with the largest id stays; null ids are smaller than all others, and of rows that repeat id
    and text exactly one stays. ``carry`` are further columns computed from ``docs``; other columns of ``docs``,
    whatever their names, play no part. An empty table gives an empty table.
    """
    carry = carry or {}
    own = {f"_x{i}": c for i, c in enumerate(carry.values())}
    rows = _rows(docs, text, normalise, _id=F.col(f"`{doc_id}`"), **own)
    # the row number is fixed by being written, and tells rows of equal id and text apart
    narrow = written(_survivors(rows, prefix).select("_id", F.monotonically_increasing_id().alias("_row"), "_n", "_p", "_full", *own), "digests")
    key = ["_n", "_p", "_full"]
    held = narrow.where("_full is not null").groupBy(*key).agg(
        F.count(F.lit(1)).alias("_size"), F.max(F.struct("_id", "_row")).alias("_best")).where("_size > 1")
    held = written(held, "groups")  # read back, so that a hot group can be dealt to several tasks of the join
    out = [F.col(n).alias(c) for n, c in zip(own, carry)]
    joined = narrow.where("_full is not null").join(held, key, "left").select(
        F.col("_id").alias("doc_id"), F.when(F.col("_size") > 1, F.col("_best._id")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("bigint")).alias("group_size"), F.coalesce(F.col("_best._row") == F.col("_row"), F.lit(True)).alias("kept"), *out)
    alone = narrow.where("_full is null").select(
        F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), *out)
    return joined.union(alone)


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None, prefix: int = PREFIX,
) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of equal texts: that of the largest id.

    The same cases as in ``groups``. Texts that are alone are not shuffled; of the others every task passes on one
    row for each text.
    """
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = _survivors(_rows(docs, text, normalise, _id=F.col(f"`{doc_id}`"), _whole=whole), prefix)
    best = rows.where("_full is not null").groupBy("_n", "_p", "_full").agg(F.max_by("_whole", F.struct("_id")).alias("_whole"))
    kept = rows.where("_full is null").select("_whole").union(best.select("_whole"))
    return kept.select(*[F.col(f"_whole.c{i}").alias(c) for i, c in enumerate(docs.columns)])
