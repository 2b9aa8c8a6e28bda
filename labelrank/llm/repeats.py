"""Removal of byte strings that occur more than once in the corpus (suffix-array dedup).

A string of ``length`` bytes is a window. Every window is led by its anchor: the run of ``gram`` bytes in it
with the smallest hash (the first among equals). Equal windows have equal anchors at the same place, so only
windows whose anchors have equal hashes need be compared, and a text of n bytes has about 2n / (length - gram)
anchors. The context of an anchor is the bytes of all windows that it leads.

1. Anchors (hash of the anchor, hash of the context, place) are dealt by anchor hash. An anchor that occurs
   once leads no repeated window. Contexts that occur twice or more are repeated as a whole.
2. Of the other anchors, one context per distinct content goes to the task of its anchor hash. A task joins
   the contexts of whole groups to blocks of bounded size, and the interval expansion of ``intervals`` on the
   block's Burrows-Wheeler transform finds the windows that occur twice.
3. A group of more than ``group`` distinct contexts is never gathered: its windows are counted one by one.

Then the repeated stretches are cut out of each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from labelrank.llm.intervals import repeated
from labelrank.llm.tables import NO_ID, written
from labelrank.llm.textops import mix, prefix_hash, range_hash, slices, text_array

_U = np.uint64
#: Windows of a piece; places within a piece fit into the low bits of a packed hash.
PIECE = 1 << 20
_PLACE_BITS = 24
#: Bytes of contexts that are indexed together.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Lengths:
    """``length``: shortest string to remove; ``gram``: bytes of an anchor, a power of two below it."""

    length: int = 200
    gram: int = 64

    def __post_init__(self):
        if self.gram & (self.gram - 1) or not 0 < self.gram <= self.length:
            raise ValueError("gram must be a power of two up to the length")


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


_FIRST = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def _gram_hash(data: np.ndarray, gram: int) -> np.ndarray:
    h, span, factor = _FIRST[data], 1, 0x9E3779B97F4A7C15
    while span < gram:
        h = h[:-span] * _U(factor) + h[span:]
        factor = factor * factor % 2**64 | 1
        span *= 2
    return mix(h)


def anchors(data: np.ndarray, starts: np.ndarray, cut: Lengths) -> dict[str, np.ndarray]:
    """Anchors of the joined texts: document, first and last window (places in the document), hashes."""
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "first", "last", "anchor", "context")}
    for low in range(0, max(0, len(data) - cut.length + 1), PIECE):
        part = data[low : low + PIECE + cut.length - 1]
        n = len(part) - cut.length + 1
        h = _gram_hash(part, cut.gram)
        packed = (h >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        at = (_sliding_min(packed, cut.length - cut.gram + 1) & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
        begin, end = np.clip(starts[:-1] - low, 0, n), np.clip(starts[1:] - low - cut.length + 1, 0, n)
        keep = end > begin
        begin, end, rows = begin[keep], end[keep], np.flatnonzero(keep)
        if not len(rows):
            continue
        valid = np.zeros(n + 1, np.int8)
        valid[begin] += 1
        valid[end] -= 1
        valid = np.cumsum(valid[:-1]).astype(bool)
        new = np.zeros(n, bool)
        new[1:] = at[1:] != at[:-1]
        new[begin] = True
        first = np.flatnonzero(new & valid)
        stops = np.zeros(n + 1, bool)
        stops[1:n] = new[1:]
        stops[end] = True
        last = np.flatnonzero(stops[1:] & valid)
        row = rows[np.searchsorted(begin, first, "right") - 1]
        sums = prefix_hash(part)
        context = range_hash(sums, first, last + cut.length)
        context = mix(context + (at[first] - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        base = starts[row] - low
        for k, v in (("row", row), ("first", first - base), ("last", last - base), ("anchor", h[at[first]]), ("context", context)):
            found[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_k, _t, text): documents are told apart by id and a 64-bit hash of the text."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("_t", F.xxhash64("text"))


def _marks(rows: DataFrame, cut: Lengths) -> DataFrame:
    """Anchors whose hash occurs more than once, with the counts of their group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, starts in slices(text_array(batch, "text")):
                a = anchors(data, starts, cut)
                own = pa.array(a["row"] + lo, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), pa.array(a["anchor"].view(np.int64)), pa.array(a["context"].view(np.int64)),
                     pa.array(a["first"], pa.int64()), pa.array(a["last"] - a["first"], pa.int32())],
                    ["_k", "_t", "anchor", "context", "first", "more"])

    found = rows.select("_k", "_t", "text").mapInArrow(run, "_k bigint, _t bigint, anchor bigint, context bigint, first bigint, more int")
    ordered = Window.partitionBy("anchor", "context").orderBy("_k", "_t", "first")
    grouped = (
        found.withColumn("copy", F.row_number().over(ordered))
        .withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("anchor", "context")))
        .withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("anchor")))
        .withColumn("kinds", F.sum(F.when(F.col("copy") == 1, 1)).over(Window.partitionBy("anchor")))
    )
    return grouped.where("members > 1").drop("members")


def _contexts(rows: DataFrame, marks: DataFrame, cut: Lengths) -> DataFrame:
    """One context per distinct content of the groups that have several, with its bytes."""
    wanted = marks.where("copy = 1 and kinds > 1").groupBy("_k", "_t").agg(
        F.collect_list(F.struct("anchor", "kinds", (F.col("copies") == 1).alias("open"), "first", "more")).alias("wanted"))
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_t").orderBy("_k"))).where("_n = 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = memoryview(batch.column(2)[i].as_buffer())
                w = batch.column(3)[i].values
                first, more = (w.field(c).to_numpy(zero_copy_only=False) for c in ("first", "more"))
                pieces = [data[a : a + m + cut.length].tobytes() for a, m in zip(first.tolist(), more.tolist())]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * n, pa.int64())), batch.column(1).take(pa.array([i] * n, pa.int64())),
                     w.field("anchor"), w.field("kinds"), w.field("open"), w.field("first"), pa.array(pieces, pa.binary())],
                    ["_k", "_t", "anchor", "kinds", "open", "first", "bytes"])

    joined = one.join(wanted, ["_k", "_t"]).select("_k", "_t", "text", "wanted")
    return joined.mapInArrow(run, "_k bigint, _t bigint, anchor bigint, kinds bigint, open boolean, first bigint, bytes binary")


SPANS = "_k bigint, _t bigint, begin bigint, end bigint"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _spans_of_block(table: pa.Table, cut: Lengths) -> pa.RecordBatch:
    """Repeated stretches of the contexts of whole groups, by interval expansion on their transform."""
    texts = [np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("bytes").combine_chunks()]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    joined = np.zeros(ends[-1], np.uint16)  # a zero after each context
    for t, e in zip(texts, ends.tolist()):
        joined[e - 1 - len(t) : e - 1] = t.astype(np.uint16) + 1
    flags = repeated(joined, cut.length)
    # windows that begin too late in their context hold a zero and don't count
    open_ = table.column("open").to_numpy()
    room = np.zeros(len(joined) + 1, np.int32)
    np.add.at(room, (ends - sizes)[open_], 1)
    np.add.at(room, (ends - cut.length)[open_], -1)
    flags &= np.cumsum(room[:-1]) > 0
    begin, end = _runs(flags)
    own = np.searchsorted(ends, begin, "right")
    base = table.column("first").to_numpy()[own] - (ends - sizes)[own]
    at = pa.array(own, pa.int64())
    return pa.RecordBatch.from_arrays(
        [table.column("_k").combine_chunks().take(at), table.column("_t").combine_chunks().take(at), pa.array(begin + base, pa.int64()),
         pa.array(end + base + cut.length - 1, pa.int64())], ["_k", "_t", "begin", "end"])


def _indexed(contexts: DataFrame, cut: Lengths) -> DataFrame:
    """Spans from the contexts of groups of bounded size, dealt by anchor and indexed block by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            anchor = batch.column(2).to_numpy()
            sizes = np.cumsum([len(b.as_buffer()) for b in batch.column(5)])
            borders = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            if last is not None and len(anchor) and anchor[0] != last:
                borders = np.concatenate([[0], borders])
            at = 0
            for b in borders.tolist():
                if size + (sizes[b - 1] if b else 0) - (sizes[at - 1] if at else 0) >= BLOCK:
                    held.append(batch.slice(at, b - at))
                    yield _spans_of_block(pa.Table.from_batches(held), cut)
                    held, size, at = [], 0, b
            if batch.num_rows > at:
                held.append(batch.slice(at))
                size += int(sizes[-1] - (sizes[at - 1] if at else 0))
                last = anchor[-1]
        if held:
            yield _spans_of_block(pa.Table.from_batches(held), cut)

    dealt = contexts.select("_k", "_t", "anchor", "open", "first", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, SPANS)


def _counted(contexts: DataFrame, cut: Lengths) -> DataFrame:
    """Spans from the contexts of groups without a bound: every window by itself, counted over the cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint8)
                n = len(data) - cut.length + 1
                begin = np.arange(n)
                h = range_hash(prefix_hash(data), begin, begin + cut.length)
                same = pa.array([i] * n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(same) for c in (0, 1, 2, 3)), pa.array(begin + batch.column(4)[i].as_py(), pa.int64()), pa.array(h.view(np.int64))],
                    ["_k", "_t", "anchor", "open", "begin", "window"])

    each = contexts.select("_k", "_t", "anchor", "open", "first", "bytes").mapInArrow(
        run, "_k bigint, _t bigint, anchor bigint, open boolean, begin bigint, window bigint")
    again = each.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.where("open").join(again, ["anchor", "window"]).select("_k", "_t", "begin", (F.col("begin") + cut.length).alias("end"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, gram: int = 64, group: int = 20_000) -> DataFrame:
    """(_k, _t, begin, end): stretches of bytes covered by repeated windows, in parts that may touch or overlap."""
    cut = Lengths(length, gram)
    rows = _keyed(docs, doc_id, text)
    marks = written(_marks(rows, cut), "anchors")
    whole = marks.where("copies > 1").select("_k", "_t", F.col("first").alias("begin"), (F.col("first") + F.col("more") + length).alias("end"))
    contexts = _contexts(rows, marks, cut)
    spans = whole.union(_indexed(contexts.where(F.col("kinds") <= group), cut))
    if marks.where(F.col("kinds") > group).limit(1).count():
        spans = spans.union(_counted(contexts.where(F.col("kinds") > group), cut))
    return spans


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, gram: int = 64, group: int = 20_000,
) -> DataFrame:
    """(doc_id, n_bytes, spans, n_removed, n_spans, kept, kept_sha256) of every row; ``kept`` is binary.

    Every byte covered by a ``length``-byte string that also begins anywhere else, in the same document or
    another, is removed, judged on the input; strings never cross documents. ``spans`` are the maximal removed
    stretches (begin, end), in bytes. Cuts may fall within a character, so the rest is bytes. Null is the empty
    text; a text shorter than ``length`` keeps everything. Rows that repeat an id and a text are copies of each
    other, and both are removed; a null id is an id. Window, context and text hashes have 64 bits.
    """
    rows = _keyed(docs, doc_id, text)
    spans = repeated_spans(docs, doc_id, text, length, gram, group)
    per_doc = spans.groupBy("_k", "_t").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = rows.join(per_doc, ["_k", "_t"], "left").select("_k", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "spans", "n_removed", "n_spans", "kept", "kept_sha256")}
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                held = batch.column(2)[i]
                depth = np.zeros(len(data) + 1, np.int32)
                if held.is_valid:
                    np.add.at(depth, held.values.field("begin").to_numpy(zero_copy_only=False), 1)
                    np.add.at(depth, held.values.field("end").to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(depth[:-1]) > 0
                begin, end = _runs(gone)
                kept = data[~gone].tobytes()
                for k, v in zip(out, (len(data), [{"begin": int(a), "end": int(b)} for a, b in zip(begin, end)], int(gone.sum()), len(begin), kept, hashlib.sha256(kept).hexdigest())):
                    out[k].append(v)
            kinds = (pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.int64(), pa.binary(), pa.string())
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, k) for v, k in zip(out.values(), kinds))], ["_k", *out])

    found = joined.mapInArrow(
        run, "_k bigint, n_bytes bigint, spans array<struct<begin: bigint, end: bigint>>, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
    return found.select(F.when(F.col("_k") != NO_ID, F.col("_k")).alias("doc_id"), "n_bytes", "spans", "n_removed", "n_spans", "kept", "kept_sha256")
