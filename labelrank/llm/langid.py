"""Language ID: multinomial naive Bayes over hashed character n-grams.

Fitting counts n-grams per language over all labelled texts; a task sends one row per language and bucket
that it has seen, so what is shuffled depends on the number of buckets, not of texts. The matrix of log
probabilities (languages x buckets) goes to every task; scoring gathers its rows for the n-grams of a batch
and adds them up per document, which is the product of the sparse count matrix with the dense one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelrank.llm.textops import SLICE_BYTES, slices, text_array

UNKNOWN = "und"
_BLANK = 32
_lower: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Per code point: the lower-case letter, or a blank for anything that is no letter."""
    global _lower
    if _lower is None:
        table = np.full(0x110000, _BLANK, np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                small = c.lower()
                table[code] = ord(small) if len(small) == 1 else code
        _lower = table
    return _lower


def _code_points(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and blanks of the joined texts, and where each document begins."""
    lead = (data & 0xC0) != 0x80
    first = np.concatenate([[0], np.cumsum(lead)])[starts]
    return _letters()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)], first


def _features(codes: np.ndarray, first: np.ndarray, sizes: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram size: the bucket of each n-gram within one document, and per document where they begin.

    An n-gram of blanks only, or one that ends in two blanks, says nothing about the language and is left out.
    """
    ends = np.repeat(first[1:], np.diff(first))
    place = np.arange(len(codes))
    for n in sizes:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ codes[k : m + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        keep = place[:m] + n <= ends[:m]
        keep &= codes[n - 1 : m + n - 1] != _BLANK if n < 2 else (codes[n - 1 : m + n - 1] != _BLANK) | (codes[n - 2 : m + n - 2] != _BLANK)
        at = np.concatenate([[0], np.cumsum(keep)])
        yield (h[keep] & np.uint32(buckets - 1)).astype(np.int64), at[np.minimum(first, m)]


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities of a fitted model; ``classes`` is in code point order."""

    classes: list[str]
    prior: np.ndarray
    weights: np.ndarray  # buckets x classes, float32
    sizes: tuple[int, ...]
    evidence: float

    @property
    def buckets(self) -> int:
        return len(self.weights)

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score per text.

        The language is the one of the largest posterior (the first in code point order among equals). As
        n-grams overlap, the posterior of a long text would always be 0 or 1; the score is the posterior
        with the evidence of at most ``evidence`` n-grams. A text without letters is ``und`` with score 0.
        """
        langs: list[str] = []
        scores: list[np.ndarray] = []
        for lo, hi, data, starts in slices(texts, SLICE_BYTES // 4):
            codes, first = _code_points(data, starts)
            total = np.zeros((hi - lo, len(self.classes)))
            grams = np.zeros(hi - lo)
            for bucket, at in _features(codes, first, self.sizes, self.buckets):
                n = np.diff(at)
                full = np.flatnonzero(n)
                if len(full):
                    total[full] += np.add.reduceat(self.weights[bucket], at[:-1][full], axis=0, dtype=np.float64)
                    grams += n
            letters = np.concatenate([[0], np.cumsum(codes != _BLANK)])
            has = np.diff(letters[first]) > 0
            best = np.argmax(total + self.prior, axis=1) if self.classes else np.zeros(hi - lo, int)
            calm = self.prior + total * np.minimum(1, self.evidence / np.maximum(grams, 1))[:, None]
            calm = np.exp(calm - calm.max(axis=1, keepdims=True)) if self.classes else np.ones((hi - lo, 1))
            sure = calm[np.arange(hi - lo), best] / calm.sum(axis=1)
            langs += [self.classes[b] if ok and self.classes else UNKNOWN for b, ok in zip(best, has)]
            scores.append(np.where(has & bool(self.classes), sure, 0.0))
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def fit(
    docs: DataFrame, text: str = "text", label: str = "lang", sizes: tuple[int, ...] = (1, 2, 3),
    buckets: int = 1 << 16, alpha: float = 0.5, evidence: float = 64.0, max_classes: int = 1000,
) -> LanguageModel:
    """Fit on every row with a text and a label. ``buckets`` is a power of two.

    Rows with a null text or label teach nothing; no rows at all give a model that answers ``und``. The
    model (classes x buckets) is held by the driver and every task; over ``max_classes`` labels is an error.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            texts, labels = batch.column(0), np.array(batch.column(1).to_pylist(), object)
            for lo, hi, data, starts in slices(texts, SLICE_BYTES // 4):
                codes, first = _code_points(data, starts)
                own = labels[lo:hi]
                for name in dict.fromkeys(own):
                    rows[name] = rows.get(name, 0) + int((own == name).sum())
                    seen.setdefault(name, np.zeros(buckets, np.int64))
                for bucket, at in _features(codes, first, sizes, buckets):
                    n = np.diff(at)
                    for name in dict.fromkeys(own):
                        mine = np.repeat(own == name, n)
                        seen[name] += np.bincount(bucket[at[0] : at[-1]][mine], minlength=buckets)
        for name, counts in seen.items():
            hit = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict(
                {"label": pa.array([name] * (len(hit) + 1), pa.string()), "bucket": pa.array(np.concatenate([[-1], hit]), pa.int32()),
                 "n": pa.array(np.concatenate([[rows[name]], counts[hit]]), pa.int64())})

    labelled = docs.select(F.col(text).alias("t"), F.col(label).cast("string").alias("l")).dropna()
    counts = labelled.mapInArrow(count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    per_class = (
        counts.groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).limit(max_classes + 1).collect()
    )
    if len(per_class) > max_classes:
        raise ValueError(f"more than {max_classes} labels")
    per_class.sort(key=lambda r: r["label"])
    classes = [r["label"] for r in per_class]
    table = np.zeros((buckets, len(classes)))
    docs_of = np.ones(len(classes))
    for j, r in enumerate(per_class):
        for c in r["counts"]:
            if c["bucket"] < 0:
                docs_of[j] = c["n"]
            else:
                table[c["bucket"], j] = c["n"]
    weights = np.log(table + alpha) - np.log(table.sum(axis=0) + alpha * buckets)
    return LanguageModel(classes, np.log(docs_of / docs_of.sum()) if classes else np.zeros(0), weights.astype(np.float32), tuple(sizes), evidence)


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; nothing but the text is looked at.

    A null text, an empty one and one without letters are ``und`` with score 0. Repeated rows give repeated
    results; other columns of ``docs`` don't matter.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = held.value.score(text_array(batch, "t"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double")
