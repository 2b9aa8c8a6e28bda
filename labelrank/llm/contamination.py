"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item counts as found in a document if at least a share of its distinct runs of five words (lower case,
marks as blanks) stands in the document. Items are partitioned by size; the sketch of an item is its k
smallest hashes, with k set by its partition so that nothing is lost: a document that holds ``share`` of n
runs misses at most n - ceil(share * n), so it holds one of any n - ceil(share * n) + 1. A document of any
length is scanned once; where it holds a sketch hash, the item is verified by exact containment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelrank.llm.tables import ARROW
from labelrank.llm.textops import LOWER, lean, shingle_runs, slices, text_array

#: Marks become blanks, capitals small letters.
_PLAIN = LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32
_FILTER = 1 << 20


def _runs(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_runs(_PLAIN[data], starts, width, lower=False)


class Items:
    """Items with their exact runs, and the partitioned sketches that lead to them."""

    def __init__(self, ids: list, texts: list[str | None], width: int, share: float):
        self.width, self.share, self.ids, self.sets = width, share, [], []
        column = pa.array(texts, pa.string()).fill_null("")
        for lo, hi, data, starts in slices(column):
            hashes, first = _runs(data, starts, width)
            for i in range(hi - lo):
                own = np.unique(hashes[first[i] : first[i + 1]])
                if len(own):
                    self.ids.append(ids[lo + i])
                    self.sets.append(own)
        self.need = np.array([math.ceil(share * len(s) - 1e-9) for s in self.sets], np.int64)
        sketches = [s[: self._sketch_size(len(s))] for s in self.sets]
        owner = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches]) if sketches else np.zeros(0, int)
        joined = np.concatenate(sketches) if sketches else np.zeros(0, np.uint64)
        by = np.argsort(joined, kind="stable")
        self.sketch, self.owner = joined[by], owner[by]
        self.seen = np.zeros(_FILTER, bool)
        self.seen[self.sketch & np.uint64(_FILTER - 1)] = True

    def _sketch_size(self, n: int) -> int:
        """Of the partition of sizes from a power of two up to the next: what its largest item needs."""
        largest = 2 ** n.bit_length() - 1
        return min(n, largest - math.ceil(self.share * largest - 1e-9) + 1)

    def find(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, place of the item, runs of the item that the row's text holds) for all that reach the share."""
        for lo, hi, data, starts in slices(texts):
            hashes, first = _runs(data, starts, self.width)
            likely = np.flatnonzero(self.seen[hashes & np.uint64(_FILTER - 1)])
            if not len(likely):
                continue
            a, b = (np.searchsorted(self.sketch, hashes[likely], side) for side in ("left", "right"))
            hit = np.flatnonzero(b > a)
            if not len(hit):
                continue
            spread = np.repeat(hit, (b - a)[hit])
            within = np.arange(len(spread)) - np.repeat(np.cumsum((b - a)[hit]) - (b - a)[hit], (b - a)[hit])
            item = self.owner[a[spread] + within]
            row = np.searchsorted(first, likely[spread], "right") - 1
            pairs = np.unique(np.stack([row, item], axis=1), axis=0)
            for r in np.unique(pairs[:, 0]):
                own = np.unique(hashes[first[r] : first[r + 1]])
                for i in pairs[pairs[:, 0] == r, 1]:
                    shared = int(np.isin(self.sets[i], own, assume_unique=True).sum())
                    if shared >= self.need[i]:
                        yield lo + int(r), int(i), shared


def _item_blocks(items: DataFrame, item_id: str, text: str, width: int, share: float, block_bytes: int) -> Iterator[Items]:
    """All items, in blocks of about ``block_bytes`` of text, by a hash of the id."""
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64(F.col("i").cast("string"), "t"), F.lit(blocks)) == b) if blocks > 1 else rows
        found = own.orderBy("i", "t").collect()
        yield Items([r["i"] for r in found], [r["t"] for r in found], width, share)


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", width: int = 5, share: float = 0.8, block_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, item_id, item_runs, shared_runs, containment) for every item found in a document.

    ``items`` goes to every task in blocks of bounded size, each against all documents, so a larger list only
    takes more scans. Null and empty texts hold nothing and items without words are found nowhere; an item of
    fewer than ``width`` words is one run, found in a text of just these words. Repeated rows repeat results.
    """
    spark = docs.sparkSession
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, item_runs bigint, shared_runs bigint, containment double"
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))

    def scan(block: Items) -> DataFrame:
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in batches:
                hits = list(own.find(text_array(batch, "t")))
                n = [len(own.sets[i]) for _, i, _ in hits]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).take(pa.array([r for r, _, _ in hits], pa.int64())),
                    "item_id": pa.array([own.ids[i] for _, i, _ in hits], ARROW[kinds[1]]),
                    "item_runs": pa.array(n, pa.int64()), "shared_runs": pa.array([s for _, _, s in hits], pa.int64()),
                    "containment": pa.array([s / k for (_, _, s), k in zip(hits, n)], pa.float64())})

        return rows.mapInArrow(lean(run), schema)

    found = [scan(b) for b in _item_blocks(items, item_id, item_text, width, share, block_bytes)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = 5, share: float = 0.8, block_bytes: int = 8 << 20,
) -> DataFrame:
    """The rows of ``docs``, all their columns, in which no item is found (see ``contained_items``)."""
    spark, schema = docs.sparkSession, docs.schema
    for block in _item_blocks(items, item_id, item_text, width, share, block_bytes):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                for row, _, _ in held.value.find(text_array(batch, text)):
                    bad[row] = True
                yield batch.filter(pa.array(~bad)) if bad.any() else batch

        docs = docs.mapInArrow(lean(run), schema)
    return docs
