"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes of whole texts, in one pass. The trees are fitted on a bounded sample of the
labelled rows (``max_rows``, taken by hash order, so the same rows whatever the partitions), whose statistics
are a few dozen numbers a row. A fitted forest is flattened into arrays: all rows of a batch go down all
trees at once, one level per step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelrank.llm.textops import LOWER, SPACE, lean, prefix_hash, range_hash, slices, words

#: The statistics, in the order of the columns.
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "commas_stops", "marks", "other_marks", "high_bytes", "spaces",
    "log_lines", "line_words", "short_lines", "distinct_words", "top_word", "distinct_lines", "repeated_line_bytes",
    "marked_words", "capital_words", "shouted_words", "long_words", "lone_marks", "mark_endings", "stop_lines",
)

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 comma and stop, 5 other marks, 6 rare marks, 7 high, 8 space
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[[33, 34, 39, 40, 41, 45, 58, 59, 63]] = 5
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and _KIND[c] == 0]] = 6
_KIND[[44, 46]] = 4
_KIND[128:] = 7
_KIND[SPACE] = 8


def _one(data: np.ndarray, begin: np.ndarray, end: np.ndarray, word: np.ndarray, line_sums: np.ndarray, base: int) -> list[float]:
    """Statistics of one text from its bytes, its words (places in the slice) and their hashes."""
    n, w = len(data), len(begin)
    kinds = np.bincount(_KIND[data], minlength=9) / max(n, 1)
    size = end - begin
    breaks = np.flatnonzero(data == 10)
    l_begin, l_end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [n]])
    l_begin, l_end = l_begin[l_end > l_begin], l_end[l_end > l_begin]
    lines = len(l_begin)
    l_words = np.searchsorted(begin, l_end + base) - np.searchsorted(begin, l_begin + base)
    l_hash = range_hash(line_sums, l_begin + base, l_end + base)
    _, l_first, l_count = np.unique(l_hash, return_index=True, return_counts=True)
    again = ((l_end - l_begin)[l_first] * (l_count - 1)).sum()
    _, counts = np.unique(word, return_counts=True)
    kind = _KIND[data]
    first, last = (kind[begin - base], kind[end - base - 1]) if w else (np.zeros(0, np.uint8),) * 2
    marks = np.concatenate([[0], np.cumsum(kind == 6)])
    ups = np.concatenate([[0], np.cumsum(kind == 1)])
    in_marks, in_ups = marks[end - base] - marks[begin - base], ups[end - base] - ups[begin - base]
    per = 1 / max(w, 1)
    return [
        np.log1p(n), np.log1p(w), size.mean() if w else 0, kinds[1], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8],
        np.log1p(lines), l_words.mean() if lines else 0, (l_words < 4).mean() if lines else 0, len(counts) * per,
        counts.max() * per if w else 0, len(l_count) / max(lines, 1), again / max(n, 1), (in_marks > 0).sum() * per,
        (first == 1).sum() * per, ((in_ups > 1) & (2 * in_ups >= size)).sum() * per, (size > 20).sum() * per,
        ((size == 1) & ((first == 5) | (first == 6))).sum() * per, ((last == 5) | (last == 6)).sum() * per,
        (np.isin(data[l_end - 1], [33, 46, 63])).mean() if lines else 0,
    ]


def statistics_of(texts: pa.Array) -> np.ndarray:
    """Rows x statistics; the empty text (and null) has zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    texts = texts.fill_null("") if texts.null_count else texts
    for lo, hi, data, starts in slices(texts):
        begin, end, first = words(data, starts)
        word = range_hash(prefix_hash(LOWER[data]), begin, end)
        sums = prefix_hash(data)
        for i in range(hi - lo):
            a, b = starts[i], starts[i + 1]
            if b > a:
                f, t = first[i], first[i + 1]
                out[lo + i] = _one(data[a:b], begin[f:t], end[f:t], word[f:t], sums, a)
    return out


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: node k of tree t splits on ``feature`` at ``cut`` (left if value <= cut); -1 is a leaf."""

    base: float
    feature: np.ndarray  # trees x nodes, heap order: children of k are 2k+1 and 2k+2
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        rows, trees = len(x), len(self.feature)
        node = np.zeros((trees, rows), np.int64)
        tree, row = np.arange(trees)[:, None], np.arange(rows)[None, :]
        for _ in range(self.depth):
            f = self.feature[tree, node]
            right = x[row, np.maximum(f, 0)] > self.cut[tree, node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node].sum(axis=0))))


def fit_forest(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
    l2: float = 1.0, min_rows: int = 10,
) -> Forest:
    """Boost ``trees`` trees on the logistic loss, each split found on histograms of ``bins`` quantile bins.

    Without rows, or with one label only, the forest is a constant (0.5 without rows).
    """
    nodes = 2 ** (depth + 1) - 1
    feature, cut, value = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    if not len(y):
        return Forest(0.0, feature, cut, value, depth)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Forest(base, feature, cut, value, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf")) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    width = bins + 1
    raw = np.full(len(y), base)
    flat = code + np.arange(x.shape[1]) * width
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        members = {0: np.arange(len(y))}
        for k in range(nodes):
            rows = members.pop(k, None)
            if rows is None:
                continue
            G, H = g[rows].sum(), h[rows].sum()
            value[t, k] = -rate * G / (H + l2)
            if k >= 2**depth - 1 or len(rows) < 2 * min_rows:
                raw[rows] += value[t, k]
                continue
            cells = flat[rows].ravel()
            shape = (x.shape[1], width)
            hg = np.bincount(cells, np.repeat(g[rows], x.shape[1]), width * x.shape[1]).reshape(shape).cumsum(axis=1)
            hh = np.bincount(cells, np.repeat(h[rows], x.shape[1]), width * x.shape[1]).reshape(shape).cumsum(axis=1)
            hn = np.bincount(cells, minlength=width * x.shape[1]).reshape(shape).cumsum(axis=1)
            gain = hg**2 / (hh + l2) + (G - hg) ** 2 / (H - hh + l2) - G**2 / (H + l2)
            gain[(hn < min_rows) | (len(rows) - hn < min_rows)] = -1
            j, b = np.unravel_index(np.argmax(gain), shape)
            if gain[j, b] <= 1e-9:
                raw[rows] += value[t, k]
                continue
            feature[t, k], cut[t, k] = j, edges[j][b]
            right = code[rows, j] > b
            members[2 * k + 1], members[2 * k + 2] = rows[~right], rows[right]
    return Forest(base, feature, cut, value, depth)


def statistics(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """All columns of ``docs`` but the text, and the statistics of the whole text as an array.

    A column of ``docs`` that has the name ``out`` already is replaced.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (text, out)]
    rows = docs.select(*keep, F.col(text).alias(out))
    schema = rows.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics_of(batch.column(batch.num_columns - 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=batch.schema.names)

    return rows.mapInArrow(lean(run), f"{fields}{', ' if fields else ''}`{out}` array<double>")


def fit(stats: DataFrame, label: str = "label", order: str = "doc_id", max_rows: int = 20_000, **settings) -> Forest:
    """Fit on the labelled rows of ``stats`` (from ``statistics``), at most ``max_rows`` of them by hash order.

    Rows with a null label don't count. ``label`` is 0 or 1.
    """
    rows = (
        stats.where(F.col(label).isNotNull())
        .select(F.col(label).cast("double").alias("y"), "statistics", F.xxhash64(F.col(order).cast("string")).alias("h"))
        .orderBy("h", "y", "statistics").limit(max_rows).collect()
    )
    x = np.array([r["statistics"] for r in rows], np.float64).reshape(len(rows), len(STATISTICS))
    return fit_forest(x, np.array([r["y"] for r in rows]), **settings)


def score(stats: DataFrame, forest: Forest, out: str = "score") -> DataFrame:
    """The rows of ``stats`` with the probability of label 1 in place of the statistics."""
    held = stats.sparkSession.sparkContext.broadcast(forest)
    keep = [c for c in stats.columns if c not in ("statistics", out)]
    rows = stats.select(*[F.col(f"`{c}`") for c in keep], "statistics")
    fields = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            x = col.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))
            parts = [held.value.score(x[i : i + 2048]) for i in range(0, len(x), 2048)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], names=[*keep, out])

    return rows.mapInArrow(lean(run), f"{fields}{', ' if fields else ''}`{out}` double")


def keep(docs: DataFrame, forest: Forest, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics_of(batch.column(batch.schema.get_field_index(text)))
            parts = [held.value.score(x[i : i + 2048]) >= threshold for i in range(0, len(x), 2048)]
            yield batch.filter(pa.array(np.concatenate(parts))) if parts else batch

    return docs.mapInArrow(lean(run), docs.schema)
