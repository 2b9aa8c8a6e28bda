"""What the operators share: the shared folder, row keys, connected components."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelrank.session import ensure_checkpoint_dir, scratch_path

#: Stands for a null document id where ids are keys; no real id may be so small.
NO_ID = -(2**63)
#: Types that ids may have.
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def crc_fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what ``written`` has written, once nothing reads it any more."""
    for df in frames:
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flagged(rows: DataFrame, h: Column, keys: DataFrame, words: int = 1 << 18) -> DataFrame:
    """``rows`` with ``_hit``: true if the 64-bit hash ``h`` of a row is one of ``keys`` (h), and for few others.

    The keys go out as a bitmap of at most ``words`` 64-bit words (2 MB), so nothing of ``rows`` is shuffled. With
    very many keys the bitmap fills up and most rows are hits.
    """
    word, bit = F.pmod(F.col("h"), F.lit(words)), F.shiftrightunsigned("h", 58).cast("int")
    bitmap = keys.select(word.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or(F.expr("shiftleft(1L, _b)")).alias("_mask"))
    found = rows.withColumn("_h", h).withColumns({"_w": F.pmod("_h", F.lit(words)), "_b": F.shiftrightunsigned("_h", 58).cast("int")})
    found = found.join(F.broadcast(bitmap), "_w", "left")
    return found.withColumn("_hit", F.expr("coalesce(shiftright(_mask, _b) & 1L, 0L) = 1L")).drop("_h", "_w", "_b", "_mask")


def _to_roots(up: DataFrame) -> DataFrame:
    """(node, root) for pointers (node, root) to smaller nodes: where each chain ends. Chains halve with every round."""
    ended = []
    live = up
    while True:
        to = up.select(F.col("node").alias("_at"), F.col("root").alias("_up"))
        moved = live.join(to, F.col("root") == F.col("_at")).select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("far")).checkpoint()
        ended.append(moved.where("not far").select("node", "root"))
        live = moved.where("far").select("node", "root")
        if not live.limit(1).count():
            break
        up = reduce(DataFrame.union, [*ended, live])
    return reduce(DataFrame.union, ended)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that it can reach.

    Each round every node points to its smallest neighbour if that is smaller, the chains of pointers are followed
    to their ends, and the links are rewritten to these ends; those within one end and repeated ones go. At least
    half of the nodes go with each round, so all rounds together cost little more than the first. Everything is
    checkpointed. Both sides of a join are tables of links and nodes; a hot node is only a hot key of a partial
    aggregate.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    found = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = _to_roots(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")).checkpoint())
        ends = ends.select(F.col("node").alias("_at"), F.col("root").alias("_end")).checkpoint()
        if found is None:
            found = ends.select(F.col("_at").alias("node"), F.col("_end").alias("root"))
        else:
            found = found.join(ends, F.col("root") == F.col("_at"), "left").select("node", F.coalesce("_end", "root").alias("root")).checkpoint()
        left = edges.join(ends, F.col("a") == F.col("_at")).select(F.col("_end").alias("x"), "b")
        left = left.join(ends, F.col("b") == F.col("_at")).select("x", F.col("_end").alias("y")).where("x <> y")
        edges = left.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct().checkpoint()
        if not edges.limit(1).count():
            return found
