"""Mixing sources to target weights, to the word.

Sizes are words. The shares of the sources are filled up like connected vessels: a source stops at a multiple
of its own size, and what it cannot take goes to the others by weight, in rounds that aggregate the table of
sources. Every document gets a random key from a hash of its id. Documents are range-sorted by source and
key; the sum of all earlier sizes of the source is the sum within the sorted part plus the totals of the
earlier parts, so a source of any size is cut by many tasks. A document is taken once per full epoch that the
budget allows, and once more where the rest of the budget begins before it; the one where the budget ends is
taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelrank.llm.tables import NO_ID, written

WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(doc_id: str = "doc_id", seed: int = 42) -> Column:
    """A hash of the id that any SQL engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, have ``weights`` by turns and share the sum of all sizes; a target
    stops at ``cap`` times its source's size and the excess is shared again by weight among the others. Sizes
    of zero get zero. Places in the order come from the sorted parts, so no list of sources is in one task.
    """
    spark = sizes.sparkSession
    ordered = written(
        sizes.select(F.col("source").isNull().alias("last"), "source", "source_size").sort("last", "source")
        .withColumn("_id", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    before, total = {}, 0
    for p, n in sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        before[p] = total
        total += n
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else None
    turn = ((place + starts[part]) % len(weights) if before else F.lit(0)).cast("int")
    weighted = ordered.select(
        "source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight"))
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > cap * F.col("source_size")
        r = weighted.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, cap * F.col("source_size"))).alias("fixed"),
            F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("capped")).first()
        if r["capped"] == capped or not r["open"]:
            break
        capped = r["capped"]
        level = (r["all"] - (r["fixed"] or 0.0)) / r["open"]
    return weighted.select(
        "source", "source_size", F.least(F.col("weight") * level, cap * F.col("source_size")).alias("target"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 42,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row; ``taken`` counts words, with repeats.

    The words taken from a source are its target rounded to a whole number, exactly. ``floor(taken / size)``
    is how often the whole document is taken, and ``taken % size`` the words of a last, partial copy. A null
    or empty text has size 0 and takes nothing; a null id is an id; equal ids are taken in the order of their
    sizes. A null source is a source of its own. Reruns agree, whatever the partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_of(text).alias("size"), random_key(doc_id, seed).alias("_key"))
    order = [F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull(), "_key", "size"]
    placed = written(
        rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mixing")
    parts = placed.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    t, s = targets.alias("t"), starts.alias("s")
    edges = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("_source"), F.col("_part").alias("_p"), "_start", "source_size", "target")
    within = Window.partitionBy("_part", "source").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = summed.join(edges, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_source")))
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("_start") - F.col("_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def materialize(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of the mixture with all their columns: whole copies, and the first words of partial ones.

    ``mixed`` is ``mix(docs)`` and ``doc_id`` names a document; rows that repeat an id and a size take
    one share each. A partial copy is its first words, one blank between them.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    shares = mixed.groupBy(key.alias("_k"), F.col("size").alias("_s")).agg(F.sort_array(F.collect_list("taken")).alias("_shares"))
    own = docs.withColumn("_k", F.coalesce(F.col(doc_id), F.lit(NO_ID))).withColumn("_s", words_of(text)).join(shares, ["_k", "_s"])
    copy = Window.partitionBy("_k", "_s").orderBy("_k")
    own = own.withColumn("_taken", F.element_at("_shares", F.row_number().over(copy))).where("_taken > 0")
    copies = F.floor(F.col("_taken") / F.col("_s")).cast("int")
    part = (F.col("_taken") % F.col("_s")).cast("int")
    lead = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), part), " ")
    pieces = F.concat(F.array_repeat(F.lit(False), copies), F.when(part > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    joined = own.withColumn("_cut", F.explode(pieces))
    return joined.withColumn(text, F.when(F.col("_cut"), lead).otherwise(F.col(text))).select(*docs.columns)
