"""Token ids of documents as binary shards: one wavelet matrix per shard.

Documents are range-sorted by id; each task encodes its part of the order and closes a shard when it has
``shard_tokens`` ids, so memory does not depend on the size of a part. Spark's Parquet writer stores the
shards, which makes them appear all or not at all when executors are lost, on any file system that Spark
knows. A shard's row holds the bytes of its matrix, the ids and lengths of its documents, and the number of
ids before it within its part; the parts' totals (one number per part) give the global position.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelrank.llm.tables import ARROW
from labelrank.llm.textops import lean, text_array
from labelrank.llm.wavelet import WaveletMatrix

#: Bytes of encoded chunks that a task keeps before it starts afresh, and what an entry takes beside its key and ids.
CACHE_BYTES, ENTRY = 96 << 20, 150
_workers: dict[str, _Encoder] = {}

# How a tokenizer file states that it lower-cases and splits words from marks.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class _Encoder:
    """Ids of whole texts by the library, with a cache of chunks between ASCII white space.

    That is exact for one form of file, which is recognized by its normalizer and pre-tokenizer: lower case, white
    space dropped, words and marks apart. Then a chunk of Latin letters goes straight to the library's BPE model,
    marks behind it by themselves; every other chunk, and any with special strings in it, is encoded by the whole
    library. With any other file each text is encoded whole.
    """

    #: Letters, then marks without the apostrophe (contractions) and brackets (special strings).
    _simple = re.compile("([a-zß-öø-ÿ]*)([!-&(-/:;=?@\\[-`{}~]*)").fullmatch

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.forget()
        with open(path, encoding="utf-8") as f:
            written = json.load(f)
        added = [t["content"] for t in written.get("added_tokens") or []]
        known = written.get("normalizer") == NORMALIZER and written.get("pre_tokenizer") == PRE_TOKENIZER
        known = known and all(t.startswith("<") and not set(t) & set(" \t\n\r\x0b\x0c") for t in added)
        known = known and (written.get("post_processor"), written["model"].get("type"), written["model"].get("dropout")) == (None, "BPE", None)
        probe = ("hello", "über", "straße", "!!", "...", "$%&", "a,b", "Añb", "ß.", "Z9")
        self.by_model = known and all(self._chunk(p.lower()) == self._whole(p) for p in probe)
        self.by_chunk = self.by_model

    def forget(self) -> None:
        """Empty the caches; the library stays."""
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _bytes_as_letters(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(_PRINTED)

    def _part(self, word: str) -> bytes:
        if word not in self.letters:
            found = self.library.model.tokenize(self._bytes_as_letters(word)) if word else []
            ids = np.array([t.id for t in found], np.uint32).tobytes()
            if self.held > CACHE_BYTES:
                return ids
            self.letters[word] = ids
            self.held += len(word) + len(ids) + ENTRY
        return self.letters[word]

    def _chunk(self, chunk: str) -> bytes:
        m = self._simple(chunk)
        return self._part(m[1]) + self._part(m[2]) if m else self._whole(chunk)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not self.by_chunk:
            return self._whole(text)
        data = text.encode()
        chunks = (data.lower() if self.by_model and b"<" not in data else data).split()
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            if self.held > CACHE_BYTES:
                self.forget()
            one, out = self._chunk if self.by_model else self._whole, []
            for c in chunks:
                ids = self.known.get(c)
                if ids is None:
                    ids = one(c.decode())
                    if self.held <= CACHE_BYTES:  # one text may hold more than the cache takes
                        self.known[c] = ids
                        self.held += len(c) + len(ids) + ENTRY
                out.append(ids)
            return b"".join(out)


def _printed() -> dict[int, str]:
    """Byte-level vocabularies write byte b as a printable character: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_PRINTED = _printed()


def _encoder(path: str) -> _Encoder:
    if path not in _workers:
        _workers[path] = _Encoder(path)
    return _workers[path]


SHARD = "part int, seq int, before bigint, n_tokens bigint, doc_ids array<{kind}>, lengths array<bigint>, matrix binary"


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
    shard_tokens: int = 1 << 20,
) -> None:
    """Encode every text, append ``end_id``, and write shards in ascending order of id to ``folder``.

    A null text is the empty text (only the end id). Null ids come first; rows that repeat an id are ordered
    by their texts. A document longer than ``shard_tokens`` is a longer shard of its own. No rows: no shard.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], np.uint32).tobytes()
        part = before = held = seq = 0
        ids, pieces = [], []

        def shard() -> pa.RecordBatch:
            nonlocal before, held, seq, ids, pieces
            tokens = np.frombuffer(b"".join(pieces), np.uint32)
            row = {
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": pa.array([before], pa.int64()),
                "n_tokens": pa.array([len(tokens)], pa.int64()), "doc_ids": pa.array([ids], pa.list_(ARROW[kind])),
                "lengths": pa.array([[len(p) // 4 for p in pieces]], pa.list_(pa.int64())),
                "matrix": pa.array([WaveletMatrix.build(tokens).to_bytes()], pa.binary()),
            }
            before, held, seq, ids, pieces = before + len(tokens), 0, seq + 1, [], []
            return pa.RecordBatch.from_pydict(row)

        try:
            for batch in batches:
                if batch.num_rows:
                    part = batch.column(2)[0].as_py()
                for doc, t in zip(batch.column(0).to_pylist(), text_array(batch, "t")):
                    piece = encoder.encode(t.as_py()) + end
                    if ids and held + len(piece) // 4 > shard_tokens:
                        yield shard()
                    ids.append(doc)
                    pieces.append(piece)
                    held += len(piece) // 4
            if ids:
                yield shard()
        finally:
            encoder.forget()

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    # Spark samples the sort keys to deal the ranges; only they are read for that, texts break ties within a range.
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "t").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(lean(run), SHARD.format(kind=kind)).write.option("compression", "uncompressed").parquet(folder)


def part_starts(spark: SparkSession, folder: str) -> dict[int, int]:
    """Ids before each part: one number per part of the range sort."""
    sums = spark.read.parquet(folder).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    starts, total = {}, 0
    for r in sorted(sums, key=lambda r: r["part"]):
        starts[r["part"]] = total
        total += r["n"]
    return starts


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards in ``folder``."""
    shards = spark.read.parquet(folder)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    starts = spark.sparkContext.broadcast(part_starts(spark, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                data = memoryview(WaveletMatrix.from_bytes(batch.column(4)[i].as_buffer()).tokens().tobytes())
                first = starts.value[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py()
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2)[i].values, pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "before", "doc_ids", "lengths", "matrix").mapInArrow(
        lean(run), f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
