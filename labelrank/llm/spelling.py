"""Spelling variants: words that differ by one edit, found with k-d trees over letter counts.

A word's point is the vector of its letter counts. One replaced letter takes one from a count and adds one to
another; one inserted letter adds one: near words lie at an L1 distance of two at most. So for each length L the
words of length L and of length L + 1 are searched, and every box of a tree that needs more steps up or down than
that is left out with all its words. What remains is compared letter by letter.

The words of a length are dealt to cells, the leaves of a tree whose cuts come from a bounded sample of words by
hash order (the cuts change the work only). A word goes to its own cell, and as a query to the cells that its box
distance allows. A task takes a cell, builds the tree below it and searches for all queries at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelrank.llm.tables import written
from labelrank.llm.textops import LOWER, lean, text_array

#: Words of a cell about, and words of a leaf of the tree in it.
CELL = 4096
LEAF = 16
#: Words whose letter counts set the cuts between cells, over all lengths.
SAMPLE = 100_000
#: Letters are counted in so many places: a to z, and the others together in the last six.
PLACES = 32
#: Distinct words, and their bytes, that a task counts before it passes them on.
HELD_WORDS, HELD_BYTES = 300_000, 1 << 24
#: Characters of a text that are split into words at once.
PIECE = 1 << 20

_LOWER = LOWER.tobytes()


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts that end where a run of letters ends."""
    at = 0
    while len(text) - at > PIECE:
        end = _OTHER.search(text, at + PIECE)
        cut = end.start() if end else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


_OTHER = re.compile("[^A-Za-zÀ-ÿ]")


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 6, rare: int = 199) -> DataFrame:
    """(word, n) of all words of at least ``min_length`` code points.

    Words are maximal runs of Latin letters with A-Z lower-cased. Where ``rare`` divides the crc32 of
    ``<doc_id>:<run>``, the run loses the code point at the checksum modulo its length (0: no run does). A null id
    counts as the empty text, a null text has no words.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % max(1, min_length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), text_array(batch, "text").to_pylist()):
                start = zlib.crc32(f"{doc}:".encode())
                for piece in _pieces(body):
                    found = Counter(runs.findall(piece.encode().translate(_LOWER).decode()))
                    before = len(held)
                    for w, c in found.items():
                        if rare:
                            h = zlib.crc32(w.encode(), start)
                            if h % rare == 0:
                                w = w[: h % len(w)] + w[h % len(w) + 1 :]
                                if len(w) < min_length:
                                    continue
                        held[w] += c
                    size += sum(map(len, found)) if len(held) > before else 0
                    if len(held) > HELD_WORDS or size > HELD_BYTES:
                        yield done()
                        size = 0
        if held:
            yield done()

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(lean(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, where each word begins; one entry more than words)."""
    ends = np.cumsum([0, *map(len, words)])
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), ends


def letter_counts(words: list[str]) -> np.ndarray:
    """Words x places: how often each letter occurs."""
    points, at = code_points(words)
    place = np.where((points >= 97) & (points < 123), points.astype(np.int64) - 97, 26 + points.astype(np.int64) % (PLACES - 26))
    word = np.repeat(np.arange(len(words)), np.diff(at))
    return np.bincount(word * PLACES + place, minlength=len(words) * PLACES).reshape(-1, PLACES).astype(np.int32)


def best_cut(counts: np.ndarray) -> tuple[int, int] | None:
    """(place, c) that splits the rows most evenly into counts of at most c and above; None if all rows are equal."""
    middle = np.partition(counts, len(counts) // 2, axis=0)[len(counts) // 2]
    best, cut = 0, None
    for c in (middle - 1, middle):
        low = (counts <= c).sum(axis=0)
        even = np.minimum(low, len(counts) - low)
        p = int(np.argmax(even))
        if even[p] > best:
            best, cut = int(even[p]), (p, int(c[p]))
    return cut


@dataclass(frozen=True)
class Cells:
    """A tree of cuts: node k splits at ``place`` and ``cut`` into ``below`` (counts <= cut) and ``above``; leaves have place -1."""

    place: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    low: np.ndarray  # nodes x places: the box of counts of a node
    high: np.ndarray

    def own(self, counts: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        node = np.zeros(len(counts), np.int64)
        while True:
            p = self.place[node]
            if (p < 0).all():
                return node
            go = np.where(counts[np.arange(len(counts)), p] <= self.cut[node], self.below[node], self.above[node])
            node = np.where(p < 0, node, go)

    def within(self, counts: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): leaves whose box a row reaches by adding at most ``up`` letters and taking at most ``down``."""
        row, node = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        ups, downs = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        rows, leaves = [], []
        while len(row):
            leaf = self.place[node] < 0
            rows.append(row[leaf])
            leaves.append(node[leaf])
            row, node, ups, downs = row[~leaf], node[~leaf], ups[~leaf], downs[~leaf]
            p = self.place[node]
            x = counts[row, p]
            parts = []
            for child in (self.below[node], self.above[node]):
                u = ups - np.maximum(0, self.low[node, p] - x) + np.maximum(0, self.low[child, p] - x)
                d = downs - np.maximum(0, x - self.high[node, p]) + np.maximum(0, x - self.high[child, p])
                ok = (u <= up) & (d <= down)
                parts.append((row[ok], child[ok], u[ok], d[ok]))
            row, node, ups, downs = (np.concatenate(c) for c in zip(*parts))
        return np.concatenate(rows), np.concatenate(leaves)


def build_cells(counts: np.ndarray, leaves: int) -> Cells:
    """About ``leaves`` cells with as many of the rows in each; the largest cell is split first by being split evenly."""
    top = np.iinfo(np.int32).max
    nodes = [(-1, 0, 0, 0)]
    low, high = [np.zeros(PLACES, np.int64)], [np.full(PLACES, top, np.int64)]
    limit = max(1, -(-len(counts) // max(1, leaves)))
    todo = [(0, np.arange(len(counts)))]
    while todo:
        k, rows = todo.pop()
        cut = best_cut(counts[rows]) if len(rows) > limit else None
        if cut is None:
            continue
        p, c = cut
        for side in (0, 1):
            l, h = low[k].copy(), high[k].copy()
            if side == 0:
                h[p] = min(h[p], c)
            else:
                l[p] = max(l[p], c + 1)
            nodes.append((-1, 0, 0, 0))
            low.append(l)
            high.append(h)
        nodes[k] = (p, c, len(nodes) - 2, len(nodes) - 1)
        under = counts[rows, p] <= c
        todo += [(len(nodes) - 2, rows[under]), (len(nodes) - 1, rows[~under])]
    place, cut, below, above = np.array(nodes, np.int64).T
    return Cells(place, cut, below, above, np.array(low), np.array(high))


def box_pairs(data: np.ndarray, asked: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of asked, rows of data) that need at most ``up`` letters more and ``down`` letters less.

    A tree over ``data`` is built on the way down; each part takes along only the queries whose box distance allows it.
    """
    none = np.zeros(len(asked), np.int64)
    todo = [(np.arange(len(data)), np.arange(len(asked)), none, none, {}, {})]
    while todo:
        rows, q, ups, downs, low, high = todo.pop()
        if not len(rows) or not len(q):
            continue
        cut = best_cut(data[rows]) if len(rows) > LEAF else None
        if cut is None:
            for lo in range(0, len(q), 4096):
                for first in range(0, len(rows), LEAF):
                    part, some = q[lo : lo + 4096], rows[first : first + LEAF]
                    diff = data[some][None, :, :] - asked[part][:, None, :]
                    ok = (np.maximum(diff, 0).sum(axis=2) <= up) & (np.maximum(-diff, 0).sum(axis=2) <= down)
                    i, j = np.nonzero(ok)
                    yield part[i], some[j]
            continue
        p, c = cut
        under = data[rows, p] <= c
        x, l, h = asked[q, p], low.get(p, 0), high.get(p, np.iinfo(np.int32).max)
        for part, l2, h2 in ((rows[under], l, min(h, c)), (rows[~under], max(l, c + 1), h)):
            u = ups - np.maximum(0, l - x) + np.maximum(0, l2 - x)
            d = downs - np.maximum(0, x - h) + np.maximum(0, x - h2)
            ok = (u <= up) & (d <= down)
            todo.append((part, q[ok], u[ok], d[ok], low | {p: l2}, high | {p: h2}))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of code points ``a`` and ``b``, equally long or b longer by one: do they differ by exactly one edit?"""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front = np.cumprod(a == b[:, :-1], axis=1).sum(axis=1)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= a.shape[1]


def near_pairs(words: list[str], foreign: list[str], shorter: list[str]) -> Iterator[tuple[str, str]]:
    """(word, word) one edit apart: among ``words``, all of one length L, and of ``foreign`` (length L) and ``shorter`` (L - 1) with them."""
    data = letter_counts(words)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    step = max(1, (1 << 22) // letters.shape[1])
    for asked, up, down in ((words, 1, 1), (foreign, 1, 1), (shorter, 1, 0)):
        if not asked or asked is shorter and not shorter[0]:
            continue
        own = np.frombuffer("".join(asked).encode("utf-32-le"), np.uint32).reshape(len(asked), -1)
        for q, d in box_pairs(data, letter_counts(asked), up, down):
            if asked is words:
                q, d = q[q < d], d[q < d]
            for lo in range(0, len(q), step):
                i, j = q[lo : lo + step], d[lo : lo + step]
                ok = one_edit(own[i], letters[j])
                yield from ((asked[x], words[y]) for x, y in zip(i[ok].tolist(), j[ok].tolist()))


def _trees(vocabulary: DataFrame) -> dict[int, Cells]:
    """Cells for every length with more words than one cell takes."""
    many = vocabulary.groupBy("length").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CELL)
    counts = {r["length"]: r["c"] for r in many.collect()}
    if not counts:
        return {}
    sample = vocabulary.where(F.col("length").isin(list(counts))).select("word", "length").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()
    out = {}
    for length, c in counts.items():
        words = [r["word"] for r in sample if r["length"] == length]
        leaves = min(-(-c // CELL), max(1, len(words) // 8))
        if leaves > 1:
            out[length] = build_cells(letter_counts(words), leaves)
    return out


def _dealt(vocabulary: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """(length, leaf, role, word, n): role 0 lies in the cell, 1 (equally long) and 2 (shorter by one) ask there."""
    held = vocabulary.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                counts = letter_counts(batch.column(0).take(pa.array(at)).to_pylist())
                parts = []
                if length in held.value:
                    own = held.value[length].own(counts)
                    row, leaf = held.value[length].within(counts, 1, 1)
                    later = leaf > own[row]  # of two cells the earlier one asks
                    parts += [(length, at, own, 0), (length, at[row[later]], leaf[later], 1)]
                else:
                    parts.append((length, at, np.zeros(len(at), np.int64), 0))
                if length + 1 in held.value:
                    row, leaf = held.value[length + 1].within(counts, 1, 0)
                    parts.append((length + 1, at[row], leaf, 2))
                else:
                    parts.append((length + 1, at, np.zeros(len(at), np.int64), 2))
                for size, rows, leaf, role in parts:
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), size), pa.int64()), pa.array(leaf, pa.int64()), pa.array(np.full(len(rows), role), pa.int32()),
                             batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))], ["length", "leaf", "role", "word", "n"])

    return vocabulary.select("word", "n", "length").mapInArrow(lean(run), "length bigint, leaf bigint, role int, word string, n bigint")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): every word of ``vocabulary`` (word, n; distinct) with every word one edit away, both ways."""
    sized = vocabulary.select("word", "n", F.length("word").cast("bigint").alias("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, groups, n = None, ([], [], []), {}

        def done() -> Iterator[pa.RecordBatch]:
            if groups[0]:
                out = ([], [], [])
                for a, b in near_pairs(*groups):
                    for x, y in ((a, b), (b, a)):
                        out[0].append(x)
                        out[1].append(y)
                        out[2].append(n[y])
                    if len(out[0]) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])
                        out = ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for length, leaf, role, word, count in zip(*columns):
                if (length, leaf) != now:
                    yield from done()
                    now, groups, n = (length, leaf), ([], [], []), {}
                groups[role].append(word)
                n[word] = count
        yield from done()

    dealt = _dealt(sized, _trees(sized)).repartition("length", "leaf").sortWithinPartitions("length", "leaf", "role")
    return dealt.mapInArrow(lean(run), "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word of the chain of forms, which has no form itself.

    Every round follows two chains one after the other, so chains halve.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = at.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        moved = at.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on"))
        at = written(moved, "forms")
        if not at.where("_on").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 6, min_count: int = 5, rare: int = 199, ratio: int = 5,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs at least ``min_count`` times.

    Words as in ``word_counts``; near words differ by exactly one inserted, deleted or replaced code point. A
    word's form is its near word that occurs most (ties: the smallest in code-point order), if that is at least
    ``ratio`` times as often; ``root`` follows forms to the end. Without documents or words: no rows. Repeated rows
    count again; other columns play no part.
    """
    counted = word_counts(docs, doc_id, text, min_length, rare).where(F.col("n") >= min_count)
    vocabulary = written(counted.where(F.length("word") >= min_length), "vocabulary")
    near = near_words(vocabulary).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    rows = vocabulary.join(near.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left")
    often = -F.col("best.m") >= ratio * F.col("n")
    rows = written(rows.select(
        "word", F.when(often, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(often, -F.col("best.m")).alias("form_n")), "variants")
    ends = roots(rows.where("form is not null")).withColumnRenamed("word", "_w")
    return rows.join(ends, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
