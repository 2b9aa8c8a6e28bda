"""N-gram Jaccard join: documents linked by the similarity of their sets of word runs, and their classes.

1. One pass makes each text's set of 64-bit run hashes. Equal sets are one node from then on, so groups of
   exact copies cost a row each.
2. The global order puts runs with small hashes first (a fixed part of the hash space, ``sampled``), by how
   many sets hold them, then the others by hash. Two sets of similarity t share one of the first
   n - ceil(t n) + 1 runs of each; a set whose rare runs already fill these has no partner and drops out.
   Only the runs of the sampled part are counted across documents.
3. Sets that share such a run form candidate groups. A group's sets go to a task together, or, if they are
   many, in blocks by size class: pairs of blocks whose sizes allow the similarity. First every block meets
   one block of its class, which connects most of a large group; then only blocks that are not connected yet.
4. A task joins its blocks with a prefix tree (``prefixtree``) and reports links that connect all it found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelrank.llm.prefixtree import linked
from labelrank.llm.tables import NO_ID, components, written
from labelrank.llm.textops import lean, mix, shingles, slices, text_array

#: Runs in a block of a large group, and in a group that stays whole.
BLOCK = 100_000
#: 64-bit words of the bitmap that keeps texts out of a shuffle: 2 MB, whatever the table's size.
WORDS = 1 << 18
_U = np.uint64


def _border(sampled: float) -> int:
    """The unsigned hash at which the sampled part of the hash space ends."""
    return min(2**64 - 1, int(sampled * 2**64))


def _signature(own: np.ndarray) -> int:
    """64-bit hash of a set, whatever the order: sum and xor of mixed hashes, mixed again."""
    h = mix(own)
    both = np.array([h.sum(dtype=np.uint64) + _U(len(own)), np.bitwise_xor.reduce(h)], np.uint64)
    return int(mix(mix(both)[:1] + both[1:]).view(np.int64)[0])


def _sets(docs: DataFrame, width: int, similarity: Fraction, sampled: float) -> DataFrame:
    """(_k, _t, s, n, low, runs): signature and size of each set, its sampled runs, and how many of these
    lie in the sampled part. Sets too small to be like another one unless equal have no runs here."""
    border = _U(_border(sampled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, starts in slices(text_array(batch, "text")):
                sig, size, low, runs = [], [], [], []
                for own in shingles(data, starts, width):
                    n = len(own)
                    below = int(np.searchsorted(own, border))
                    prefix = n - math.ceil(similarity * n) + 1
                    alone = n == 0 or math.floor(n / similarity) == n and math.ceil(similarity * n) == n
                    sig.append(_signature(own) if n else None)
                    size.append(n)
                    low.append(below)
                    runs.append(own[:0] if alone else own[: max(below, prefix)])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32()), pa.array(np.concatenate(runs).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sig, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(low, pa.int64()), lists], ["_k", "_t", "s", "n", "low", "runs"])

    return docs.mapInArrow(lean(run), "_k bigint, _t bigint, s bigint, n bigint, low bigint, runs array<bigint>")


def _candidates(sets: DataFrame, nodes: DataFrame, similarity: Fraction, sampled: float) -> DataFrame:
    """(s, run): the runs among the first of a set's order that other sets hold, too.

    Only (s, run) goes through the exchange of all listed runs; sizes come back from ``nodes`` (s, n, low). In the
    result and behind that exchange a run is its place in the global order, one number: a step of how many sets
    hold it (the leading two bits and their position), then the first 56 bits of its hash. Runs that agree in all
    of that only make more candidates.
    """
    each = sets.where(F.size("runs") > 0).select("s", F.explode("runs").alias("run")).repartition("run")
    one = Window.partitionBy("run", "s").orderBy("s")
    all_of = Window.partitionBy("run")
    # copies of a set count once; all this takes a single exchange by run
    counted = each.withColumn("copy", F.row_number().over(one)).withColumn("held", F.sum(F.when(F.col("copy") == 1, 1)).over(all_of))
    shared = counted.where("copy = 1 and held > 1")
    # a run behind the sampled part is only listed if it is needed, and stands as held by none
    in_part = F.col("run").bitwiseXOR(F.lit(-(2**63))) < F.lit(_border(sampled) - 2**63)
    step = F.expr("2 * length(bin(held)) + (shiftright(held, length(bin(held)) - 2) & 1)").cast("bigint")
    place = F.shiftleft(F.when(in_part, step).otherwise(F.lit(0).cast("bigint")), 56).bitwiseOR(F.shiftrightunsigned("run", 8))
    per_set = shared.select("s", place.alias("place")).groupBy("s").agg(F.sort_array(F.collect_list("place")).alias("places")).join(nodes, "s")
    num, den = similarity.numerator, similarity.denominator
    first = F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den) - F.lit(1e-9)) + 1
    late = F.size(F.filter("places", lambda p: p < F.lit(2**56)))
    early = F.size("places") - late
    # unshared runs of the sampled part come first
    room = F.greatest(F.lit(0), F.least(first, F.col("low")) - (F.col("low") - early))
    taken = F.slice("places", F.lit(1), (late + F.least(room, early)).cast("int"))
    return per_set.select("s", F.explode(taken).alias("run"))


def _stars(candidates: DataFrame) -> DataFrame:
    """(a, b): every set with the smallest set that shares a leading run."""
    lowest = candidates.groupBy("run").agg(F.min("s").alias("b"), F.max("s").alias("top")).where("b < top")
    return candidates.join(lowest, "run").where("s <> b").select(F.col("s").alias("a"), "b").distinct()


def _hash_block(count: Column) -> Column:
    return F.pmod(F.xxhash64("s"), F.greatest(F.lit(1), count)).cast("int")


def _tiles(members: DataFrame, pivots_only: bool) -> DataFrame:
    """(tile, side, s) from (s, n, comp, cls, settled): pairs of blocks whose sets must be compared.

    ``settled`` is the class that a set is known to belong to if most of its size class do, else null.
    """
    sized = members.groupBy("comp", "cls", "settled").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    c, z = members.alias("c"), sized.alias("z")
    placed = c.join(z, (F.col("c.comp") == F.col("z.comp")) & (F.col("c.cls") == F.col("z.cls")) & F.col("c.settled").eqNullSafe(F.col("z.settled"))).select(
        "c.s", "c.comp", "c.cls", "c.settled", _hash_block(F.col("blocks")).alias("block"))
    each = sized.select("comp", F.col("cls").alias("cls2"), F.col("settled").alias("settled2"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block2"))
    pairs = placed.join(each, "comp").where("abs(cls - cls2) <= 1 and not (settled is not null and settled2 is not null and settled = settled2)")
    if pivots_only:
        pairs = pairs.where("block = 0 or block2 = 0")
    me = F.struct("cls", F.coalesce("settled", F.lit(NO_ID)).alias("settled"), "block")
    other = F.struct(F.col("cls2").alias("cls"), F.coalesce("settled2", F.lit(NO_ID)).alias("settled"), F.col("block2").alias("block"))
    tile = F.to_json(F.struct("comp", F.least(me, other).alias("x"), F.greatest(me, other).alias("y")))
    return pairs.select(tile.alias("tile"), (me > other).cast("int").alias("side"), "s")


def _links(rows: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b): links found by the prefix tree within each tile of (tile, side, s, runs)."""
    num, den = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sides, sets = None, [], [], []

        def done() -> pa.RecordBatch:
            pairs = linked(sets, np.array(sides), num, den)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, (key, side, s) in enumerate(zip(keys, batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if key != now:
                    if len(ids) > 1:
                        yield done()
                    now, ids, sides, sets = key, [], [], []
                ids.append(s)
                sides.append(side)
                sets.append(batch.column(3)[i].values.to_numpy(zero_copy_only=False).view(np.uint64).copy())
        if len(ids) > 1:
            yield done()

    dealt = rows.select("tile", "side", "s", "runs").repartition("tile").sortWithinPartitions("tile", "side", "s")
    return dealt.mapInArrow(lean(run), "a bigint, b bigint")


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``_hit``: true if (_k, _t) is one of ``keys``, and for few others.

    The keys go out as a bitmap of at most ``WORDS`` words, so nothing of ``rows`` is shuffled. With very many
    keys the bitmap fills up and most rows are hits, which costs work later but changes no result.
    """
    h = F.xxhash64("_k", "_t")
    word, bit = F.pmod(h, F.lit(WORDS)), F.shiftrightunsigned(h, 58).cast("int")
    bitmap = keys.select(word.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or(F.expr("shiftleft(1L, _b)")).alias("_mask"))
    found = rows.withColumns({"_w": word, "_b": bit}).join(F.broadcast(bitmap), "_w", "left")
    return found.withColumn("_hit", F.expr("coalesce(shiftright(_mask, _b) & 1L, 0L) = 1L")).drop("_w", "_b", "_mask")


def _full_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(s, comp, large, runs): the whole sets of ``members``, from the texts that stand for them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, starts in slices(text_array(batch, "text")):
                runs = shingles(data, starts, width)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32()), pa.array(np.concatenate(runs).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:3]), lists], ["s", "comp", "large", "runs"])

    copies = Window.partitionBy("_k", "_t").orderBy("_k")
    one = _marked(docs, members).where("_hit").join(members, ["_k", "_t"]).withColumn("_n", F.row_number().over(copies)).where("_n = 1")
    return one.select("s", "comp", "large", "text").mapInArrow(lean(run), "s bigint, comp bigint, large boolean, runs array<bigint>")


def _labels(docs: DataFrame, doc_id: str, text: str, width: int, similarity: Fraction, sampled: float | None) -> DataFrame:
    """(_k, _t, n, label) of every row: the node of its class, null for the empty set."""
    similarity = Fraction(similarity)
    share = float(min(1, 1 - similarity + Fraction(1, 5))) if sampled is None else sampled
    step = math.log(1 / similarity) + 1e-6  # sizes of linked sets lie in the same or neighbouring classes
    rows = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_t", F.xxhash64("text"))
    sets = written(_sets(rows.select("_k", "_t", "text"), width, similarity, share), "sets")
    one_of = sets.select("s", "n", "low", "_k", "_t").groupBy("s").agg(
        F.min(F.struct("_k", "_t")).alias("one"), F.first("n").alias("n"), F.first("low").alias("low"))
    nodes = written(one_of, "nodes")
    candidates = written(_candidates(sets, nodes.select("s", "n", "low"), similarity, share), "candidates")
    groups = components(_stars(candidates))
    members = groups.select(F.col("node").alias("s"), F.col("root").alias("comp")).join(nodes, "s").select(
        "s", "comp", "n", F.col("one._k").alias("_k"), F.col("one._t").alias("_t"), F.floor(F.log("n") / step).cast("int").alias("cls"))
    size = members.groupBy("comp").agg((F.sum("n") > BLOCK).alias("large"))
    members = written(members.join(size, "comp"), "members")
    full = written(_full_sets(rows, members.select("s", "comp", "large", "_k", "_t"), width), "runs")

    whole = full.where(~F.col("large")).select(F.col("comp").cast("string").alias("tile"), F.lit(0).alias("side"), "s", "runs")
    large = members.where("large").select("s", "n", "comp", "cls", F.lit(None).cast("bigint").alias("settled"))
    many = full.where("large").select("s", "runs")
    links = written(_links(whole, similarity).union(_links(_tiles(large, True).join(many, "s"), similarity)), "links")
    if large.limit(1).count():
        known = components(links)
        labelled = large.drop("settled").join(known, large.s == known.node, "left").withColumn("label", F.coalesce("root", "s"))
        counts = labelled.groupBy("comp", "cls", "label").agg(F.count(F.lit(1)).alias("c"))
        most = counts.groupBy("comp", "cls").agg(F.max(F.struct("c", "label")).alias("m")).select("comp", "cls", F.col("m.label").alias("main"))
        second = labelled.join(most, ["comp", "cls"]).select("s", "n", "comp", "cls", F.when(F.col("label") == F.col("main"), F.col("label")).alias("settled"))
        links = links.union(written(_links(_tiles(written(second, "second"), False).join(many, "s"), similarity), "links"))
    found = components(links)
    joined = sets.select("_k", "_t", "s", "n").join(found, sets.s == found.node, "left")
    return joined.select("_k", "_t", "n", F.coalesce("root", "s").alias("label"))


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: Fraction = Fraction(4, 5),
    sampled: float | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Words are runs of bytes but ASCII white space, with A-Z lower-cased; a document's set holds its distinct
    runs of ``width`` words, or all its words as one run if there are fewer. Documents link when intersection
    over union is at least ``similarity``, exactly (set elements are 64-bit hashes, and so is what tells texts of one id apart). ``component_id`` is the
    smallest id reachable by links. Null and empty texts and texts without words have the empty set and link
    with nothing: each is its own class. Rows that repeat an id have a row each; a null id is a document, and
    its class has the smallest id of the others, or null. ``sampled`` is the part of the hash space whose runs
    are counted; it changes the work, not the result.
    """
    labelled = written(_labels(docs, doc_id, text, width, similarity, sampled), "labels")
    ids = F.when(F.col("_k") != NO_ID, F.col("_k"))
    lowest = labelled.where("label is not null").groupBy("label").agg(F.min(ids).alias("lowest")).select(F.col("label").alias("_label"), "lowest")
    lowest = written(lowest, "lowest")  # read back, so that a hot class can be dealt to several tasks of the join
    joined = labelled.join(lowest, labelled.label == lowest._label, "left")
    return joined.select(ids.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), ids).otherwise(F.col("lowest")).alias("component_id"))


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: Fraction = Fraction(4, 5),
    sampled: float | None = None,
) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each class of ``classes``: the smallest id.

    Null ids come after all others. Documents without words are all kept. Of rows that repeat an id and a text
    one is kept, whichever has words.
    """
    labelled = written(_labels(docs, doc_id, text, width, similarity, sampled), "labels")
    none = labelled.where("label is null").select("_k", "_t").distinct()
    held = labelled.where("label is not null").groupBy("label").agg(
        F.min(F.struct((F.col("_k") == NO_ID).alias("last"), "_k", "_t")).alias("m"), F.count(F.lit(1)).alias("rows"))
    best = written(held, "best")
    keep = none.withColumn("_all", F.lit(True)).union(best.select("m._k", "m._t", F.lit(False)))
    several = labelled.join(best.where("rows > 1").select("label"), "label").select("_k", "_t")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # own names, whatever the columns are called
    rows = _marked(docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(NO_ID)).alias("_k"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_t")), several)
    # only rows of classes with several rows meet the list of those that stay
    kept = rows.where("_hit").join(keep, ["_k", "_t"]).withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_t").orderBy("_k")))
    out = [F.col(n).alias(c) for c, n in names.items()]
    return rows.where("not _hit").select(*out).union(kept.where("_all or _n = 1").select(*out))
