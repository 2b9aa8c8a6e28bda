"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens that the tokenizer can never join. The lengths of the frequent ones lie in a
compact table that every task gets; a miss is encoded once per worker and kept in its cache, which is emptied
when it is full. Pre-tokens are never shuffled: the frequent ones are found by adding up bounded summaries,
one per task.

For a sentencepiece BPE model a pre-token is a run of blanks with the characters after it, or a line break.
That is exact if no piece holds a blank behind another character, no piece holds a line break, and the
normalizer leaves texts as they are; the first two are checked against the vocabulary. For a ``tokenizers``
file, whose rules may look across blanks, whole lines would not be safe either, so texts are encoded whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelrank.llm.textops import lean, text_array

_cut = re.compile(" +[^ \n]*|\n|[^ \n]+").findall
#: Misses that a task keeps before it starts afresh, and their characters.
CACHE, CACHE_CHARS = 250_000, 1 << 24
_workers: dict[str, object] = {}


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text with the blank that the model puts in front; none for the empty text."""
    return _cut(" " + (text.replace("▁", " ") if "▁" in text else text)) if text else []


def _model(path: str):
    """The library's model, once per worker process."""
    if path not in _workers:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
                raise ValueError("this vocabulary has pieces across blanks or line breaks; pre-tokens are not independent")
            if not all(model.encode(t, out_type=str) == out for t, out in (("a  b ", ["▁a", "▁", "▁b", "▁"]),)):
                raise ValueError("this model changes blanks; pre-tokens are not independent")
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
        _workers[path] = model
    return _workers[path]


def _lengths(path: str, parts: list[str]) -> list[int]:
    """Tokens of each pre-token. A line break in front keeps the model from putting its own blank there."""
    return [len(ids) - 2 for ids in _model(path).encode(["\n" + p for p in parts], num_threads=1)] if parts else []


class _Lookup:
    """Frequent lengths from the shared table, and this worker's own cache."""

    def __init__(self, path: str, frequent: tuple[bytes, np.ndarray]):
        names, lengths = frequent
        self.path, self.chars = path, 0
        self.frequent = dict(zip(names.decode().split("\0"), lengths.tolist())) if len(lengths) else {}
        self.known = dict(self.frequent)

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            parts = pre_tokens(text)
            try:
                out.append(sum(map(self.known.__getitem__, parts)))
            except KeyError:
                missing = [p for p in dict.fromkeys(parts) if p not in self.known]
                if len(self.known) + len(missing) > len(self.frequent) + CACHE or self.chars > CACHE_CHARS:
                    self.known, self.chars = dict(self.frequent), 0
                    missing = [p for p in dict.fromkeys(parts) if p not in self.known]
                self.known.update(zip(missing, _lengths(self.path, missing)))
                self.chars += sum(map(len, missing))
                out.append(sum(map(self.known.__getitem__, parts)))
        return out


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", size: int = 50_000, per_task: int = 20_000) -> tuple[bytes, np.ndarray]:
    """The most frequent pre-tokens of all documents and their lengths: names joined by NUL, lengths in 16 bits.

    Each task counts its texts in a table that is cut back to the ``per_task`` most frequent entries when it
    has grown tenfold, and sends that many rows. The table only decides what is looked up where, never a count.
    """
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in text_array(batch, "t").to_pylist():
                seen.update(pre_tokens(t))
                if len(seen) > 10 * per_task:
                    seen = Counter(dict(seen.most_common(per_task)))
        top = [(p, n) for p, n in seen.most_common(per_task) if "\0" not in p and len(p) <= 64]
        yield pa.RecordBatch.from_pydict({"p": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    found = docs.select(F.col(text).alias("t")).mapInArrow(lean(summary), "p string, n bigint").groupBy("p").agg(F.sum("n").alias("n"))
    parts = [r["p"] for r in found.orderBy(F.desc("n"), "p").limit(size).collect()]
    return "\0".join(parts).encode(), np.array(_lengths(path, parts), np.uint16)


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as the library for the file at ``path`` counts.

    ``path`` is a ``.model`` (sentencepiece) or ``.json`` (tokenizers) file that every worker can open. No
    begin, end or added special tokens; special strings inside a text are treated as the library does by
    default. Null counts as the empty text, which has no tokens. Repeated rows give repeated results.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    pieces = path.endswith(".model")
    held = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text) if pieces else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(path, held.value) if pieces else None
        for batch in batches:
            texts = text_array(batch, "t").to_pylist()
            if lookup:
                counts = lookup.count(texts)
            else:
                counts = [len(e.ids) for e in _model(path).encode_batch(texts, add_special_tokens=False)]
            sizes = batch.column(2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("b"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
