"""SimHash fingerprints in DataFrame functions only.

The terms of a text are its runs of five words (lower case; a shorter text is one run). Every occurrence of a
term votes, so a term weighs as often as it occurs: each of 64 hash bits adds or takes one. Words are hashed once,
terms are hashes of five such numbers. The 64 counters of some hundred terms are packed into eight sums, then two
by two into 32, and added up by hash aggregation. Fingerprints within a
Hamming radius r are found with permuted block tables: of b blocks of bits at least b - r are untouched, so
two such fingerprints agree in all bits of some choice of b - r blocks, and each choice is one table.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelrank.llm.tables import NO_ID, written

BITS = 64
#: Terms whose votes fit into lanes of eight bits, the highest of them without the sign.
CHUNK = 120
_BYTES = 0x0101010101010101
_PAIR = 0x000000FF000000FF
_LOW = 0xFFFFFFFF
_SPACES = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    return F.transform(F.filter(F.split(F.lower(text), _SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))


def _filled(words: Column, width: int) -> Column:
    """At least ``width`` hashes: a short text is one term, filled up with zeros."""
    return F.concat(words, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.lit(width) - F.size(words)).cast("int")))


def _votes(rows: DataFrame, keys: list[str], words: str, width: int) -> DataFrame:
    """(keys, n, v0 ... v31): the number of terms in the array ``words`` of each row, and 64 counters of bits, two in each sum.

    A term is ``width`` hashes in a row. Up to ``CHUNK`` terms of a text are first added up in eight sums with eight
    lanes of eight bits, which are taken apart once for all of them.
    """
    at = F.size(words) - (width - 1)
    runs = F.arrays_zip(*[F.slice(words, F.lit(k + 1), F.greatest(at, F.lit(0))).alias(f"w{k}") for k in range(width)])
    terms = rows.select(*keys, F.posexplode(runs).alias("_at", "_t"))
    hashed = terms.select(*keys, F.expr(f"_at div {CHUNK}").alias("_c"), F.xxhash64(*[F.col(f"_t.w{k}") for k in range(width)]).alias("_h64"))
    lanes = [F.sum(F.shiftrightunsigned("_h64", j).bitwiseAND(F.lit(_BYTES))).alias(f"b{j}") for j in range(8)]
    parts = hashed.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("n"), *lanes)
    pairs = [F.sum(F.shiftrightunsigned(f"b{j}", 8 * lane).bitwiseAND(F.lit(_PAIR))).alias(f"v{8 * lane + j}") for lane in range(4) for j in range(8)]
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), *pairs)


def _fingerprint(n: Column, sums: list[Column]) -> Column:
    """A bit is set where more than half of the terms have it."""
    low = [s.bitwiseAND(F.lit(_LOW)) for s in sums]
    high = [F.shiftrightunsigned(s, 32) for s in sums]
    bits = [F.when(2 * c > n, F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")) for b, c in enumerate([*low, *high])]
    return reduce(Column.bitwiseOR, bits)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", width: int = 5) -> DataFrame:
    """(keys, fingerprint as a 64-bit number) for each distinct combination of ``keys``.

    Null and empty texts, and texts of white space, have the fingerprint of no words. Rows with equal keys are
    taken as parts of one text. A bit is set where the votes for it are more than those against it.
    """
    rows = texts.select(*keys, _filled(_words(F.coalesce(F.col(text), F.lit(""))), width).alias("_words"))
    voted = _votes(rows, keys, "_words", width)
    return voted.select(*keys, _fingerprint(F.col("n"), [F.col(f"v{j}") for j in range(BITS // 2)]).alias("fingerprint"))


def edit_fingerprints(edited: DataFrame, width: int = 5) -> DataFrame:
    """(_k, _h, own, edit): fingerprints of the texts and the edited texts in the rows of ``edits``, copies once.

    Both begin with the same words. Terms within these vote once, for both texts; only the terms behind them are
    built twice.
    """
    kept = F.col("_kept")
    words, start, tail = _words(F.col("text")), _words(kept), F.regexp_extract(kept, r"[^\x20\x09-\x0D]*$", 0)
    whole = F.size("_start") - F.when(F.col("_tail") != "", 1).otherwise(0)  # words of the text that the edit surely leaves
    # copies once; a plain comparison would go below the exchange of texts, which then served this reader only
    rows = edited.where(f"pmod(_copy, {2**31 - 1}) = 1").select("_k", "_h", "_head", words.alias("_all"), start.alias("_start"), tail.alias("_tail"))
    rows = rows.select("_k", "_h", "_all", whole.alias("_m"), _words(F.concat("_tail", "_head")).alias("_new"))
    shared = F.greatest(F.lit(0), F.col("_m") - (width - 1))
    rows = rows.withColumn("_s", shared)
    begin, rest = F.slice("_all", F.lit(1), F.col("_s") + (width - 1)), F.col("_s") + 1
    same = F.when(F.col("_s") > 0, begin).otherwise(F.array().cast("array<bigint>"))
    own = F.slice("_all", rest, F.size("_all"))
    edit = F.concat(F.slice("_all", rest, F.greatest(F.lit(0), F.col("_m") - F.col("_s"))), F.col("_new"))
    fill = lambda w: F.when(F.col("_s") > 0, w).otherwise(_filled(w, width))
    three = F.array(*[F.struct(F.lit(which).alias("which"), w.alias("words")) for which, w in ((2, same), (0, fill(own)), (1, fill(edit)))])
    each = rows.select("_k", "_h", F.explode(three).alias("v")).select("_k", "_h", F.col("v.which").alias("which"), F.col("v.words").alias("words"))
    voted = _votes(each, ["_k", "_h", "which"], "words", width)
    sums = [F.sum(F.when(F.col("which") != 1 - side, F.col(c)).otherwise(F.lit(0).cast("bigint"))).alias(f"{name}_{c}")
            for side, name in ((0, "own"), (1, "edit")) for c in ("n", *[f"v{j}" for j in range(BITS // 2)])]
    both = voted.groupBy("_k", "_h").agg(*sums)
    return both.select("_k", "_h", *[_fingerprint(F.col(f"{name}_n"), [F.col(f"{name}_v{j}") for j in range(BITS // 2)]).alias(name) for name in ("own", "edit")])


def shown(fingerprint: Column) -> Column:
    """16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits: about 0.5 for unrelated texts, 1 for equal ones."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """A row per block table: (prints' columns, table, key): the bits of the chosen blocks."""
    edges = [BITS * b // blocks for b in range(blocks + 1)]
    masks = [sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    masks = [m - 2**BITS if m >= 2 ** (BITS - 1) else m for m in masks]
    keys = F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks])
    return prints.select("*", F.posexplode(keys).alias("table", "key"))


def search(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fingerprint, match, distance): for each distinct query fingerprint, all distinct ``prints`` within ``radius``.

    Both have a column ``fingerprint``; nulls match nothing. Equal fingerprints are one row, so groups of
    copies cost nothing here. ``blocks`` over ``radius`` sets the length of the keys: with 6 and 3, about 32
    bits. A pair that several tables find is kept where it is found first.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("blocks must be more than radius")
    left = _tables(queries.select("fingerprint").dropna().distinct(), radius, blocks)
    right = _tables(prints.select("fingerprint").dropna().distinct(), radius, blocks).withColumnRenamed("fingerprint", "match")
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("match")))
    found = left.join(right, ["table", "key"]).where(distance <= radius)
    return found.groupBy("fingerprint", "match").agg(F.first(distance).alias("distance"))


def with_next(docs: DataFrame, doc_id: str, size: Column) -> DataFrame:
    """(_k, _h, prev_k, prev_h, prev_size): for every document the one before it in descending order of id.

    The one before the first is the last. Documents are distinct pairs of id and text hash. The order comes
    from a range sort of these narrow rows; the last row of each sorted part, one per part, goes to the driver.
    """
    rows = docs.select("_k", "_h", size.alias("_size")).distinct()
    placed = written(rows.repartitionByRange(F.desc("_k"), F.desc("_h")).withColumn("_part", F.spark_partition_id()), "order")
    lasts = placed.groupBy("_part").agg(F.min(F.struct("_k", "_h", "_size")).alias("r")).orderBy("_part").collect()
    spark = docs.sparkSession
    before = [(r["_part"], *lasts[i - 1]["r"]) for i, r in enumerate(lasts)]
    edge = spark.createDataFrame(before, "_p int, _ek bigint, _eh bigint, _es bigint")
    w = Window.partitionBy("_part").orderBy(F.desc("_k"), F.desc("_h"))
    here = placed.select("*", *[F.lag(c).over(w).alias(f"_l{c}") for c in ("_k", "_h", "_size")])
    joined = here.join(F.broadcast(edge), F.col("_part") == F.col("_p"))  # one row per part
    first = F.col("_l_k").isNull()
    return joined.select("_k", "_h", *[
        F.when(first, F.col(e)).otherwise(F.col(f"_l{c}")).alias(f"prev{c}") for c, e in (("_k", "_ek"), ("_h", "_eh"), ("_size", "_es"))])


def edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: int = 3) -> DataFrame:
    """(_k, _h, _copy, text, n_chars, _kept, _head, edited, prev_k, prev_h): every document with its edited text.

    The last floor(n_chars / part) code points are replaced by the first as many (``_head``) of the next document
    in descending order of id. Null ids come last in that order; rows that repeat an id are ordered by the hash of
    their texts, and rows that repeat id and text count as one document with repeated results.
    """
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(NO_ID)).alias("_k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    order = with_next(rows, doc_id, F.length("text").cast("bigint"))
    copy = Window.partitionBy("_k", "_h").orderBy("_k")
    # all readers need the number of a copy and the same columns, so that one exchange of texts serves them
    held = rows.withColumn("_copy", F.row_number().over(copy)).where("_copy >= 1").join(order, ["_k", "_h"])
    heads = held.select(
        F.col("prev_k").alias("_k"), F.col("prev_h").alias("_h"),
        F.when(F.col("_copy") == 1, F.expr(f"left(text, int(floor(prev_size / {part})))")).alias("_head")).where("_head is not null")
    kept = F.expr(f"left(text, int(length(text) - floor(length(text) / {part})))")
    return held.join(heads, ["_k", "_h"]).select(
        "_k", "_h", "_copy", "text", F.length("text").cast("bigint").alias("n_chars"), kept.alias("_kept"), "_head",
        F.concat(kept, "_head").alias("edited"), "prev_k", "prev_h")
