"""Phrases whose words stand together more often than the words by themselves suggest.

1. Words are counted. Those that occur often enough are ranked by frequency; the first ``HEAD`` ranks, over all
   languages, are the ids of a broadcast dictionary.
2. A task turns its texts into ids and counts pairs of neighbours by direct-address tiling: a pair belongs to the
   tile of its ids' leading bits. Tiles at the frequent corner that hold many pairs are counted with a dense
   bincount, the others as sorted coordinate lists. Only (pair, count) leaves the task; sums are Spark's.
3. Frequent pairs are ranked in turn, and a phrase of three words is a pair of such a rank and a word, counted in
   the same tiles. A phrase can only be frequent if both its pairs are, which drops most phrases before counting.

Words and pairs behind the ranks are counted the same way with ids of the task's own, which become texts again
when they leave it. Bitmaps of fixed size, made from all frequent words and pairs, drop most that are rare; what
they let through by mistake is dropped by its count. So nothing that grows with the data is broadcast, and no
result depends on the sizes below.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from labelrank.llm.tables import written
from labelrank.llm.textops import lean, text_array

#: Words with an id of their own, over all languages; at most 2**20.
HEAD = 1 << 17
#: Pairs of such words with a rank.
PAIRS = 1 << 20
#: Ids of a tile's side, and tiles on a side of the corner that may be dense.
TILE, EDGE = 1 << 10, 16
#: A tile is dense if it has a pair for so many cells.
SPARSE = 64
#: Bytes that become words at once, and pairs that a task holds before it counts them.
CHUNK, BLOCK = 1 << 20, 1 << 20
#: Words that are not in the dictionary and are held with a number of their own, and words that are counted at once.
OTHERS, COUNTED = 60_000, 120_000
#: Bits of a bitmap: the largest prime below 2**24.
BITS = 16_777_213

_SHIFT = 21
_MASK = (1 << _SHIFT) - 1
_GAP = b"\xff"  # stands in no UTF-8 text
_CLASSES = bytes(255 if i in b".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i < 91 else 32 if i == 9 else i for i in range(256))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, Iterator[list[bytes]]]]:
    """(language, lists of words) of a batch (lang, text); gaps between pieces and between documents are words, too."""
    per: dict[str, list[bytes]] = {}
    size = 0
    for lang, text in zip(batch.column(0), text_array(batch, "text")):
        per.setdefault(lang.as_py(), []).append(text.as_buffer().to_pybytes().translate(_CLASSES))
        size += len(text.as_buffer())
        if size > 4 * CHUNK:
            yield from ((lang, _split(_GAP.join(texts))) for lang, texts in per.items())
            per, size = {}, 0
    yield from ((lang, _split(_GAP.join(texts))) for lang, texts in per.items())


def _split(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > CHUNK:
            cut = max(data.rfind(b" ", at, at + CHUNK), data.rfind(_GAP, at, at + CHUNK))
            if cut < at:
                later = [p for p in (data.find(b" ", at), data.find(_GAP, at)) if p >= 0]
                cut = min(later, default=end - 1)
            end = cut + 1
        yield data[at:end].replace(_GAP, b" \xff ").split()
        at = end


def _word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = {}

        def done() -> pa.RecordBatch:
            langs, words, counts = [], [], []
            for lang, c in held.items():
                c.pop(_GAP, None)
                langs += [lang] * len(c)
                words += c
                counts += c.values()
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, lists in _chunks(batch):
                for words in lists:
                    held.setdefault(lang, Counter()).update(words)
                    if sum(map(len, held.values())) > COUNTED:
                        yield done()
        yield done()

    return rows.mapInArrow(lean(run), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _border(df: DataFrame, count: str, most: int) -> int:
    """The smallest count from which on at most ``most`` rows are left."""
    sums = Window.orderBy(F.desc("v"))  # one row per count that occurs
    steps = df.groupBy(F.col(count).alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("s", F.sum("c").over(sums))
    found = steps.where(F.col("s") <= most).agg(F.min("v")).first()[0]
    return 2**62 if found is None else found


def _bitmap(positions: DataFrame) -> bytes:
    """The bitmap with the bits of (p) set: 2 MB whatever the table's size."""
    words = positions.select(F.expr("p div 64").alias("w"), F.expr("cast(p % 64 as int)").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m"))
    out = np.zeros(BITS // 64 + 1, np.uint64)
    found = words.toArrow()
    out[found["w"].to_numpy()] = found["m"].to_numpy().view(np.uint64)
    return out.tobytes()


class _Known:
    """What tasks are told: ids of words, ranks of pairs, bitmaps of what lies behind them."""

    def __init__(self, words: pa.Table, other_words: bytes | None):
        order = words.sort_by([("n", "descending"), ("lang", "ascending"), ("word", "ascending")])
        self.lang, self.word = order["lang"].to_pylist(), order["word"].to_pylist()
        self.other_words, self.pairs, self.other_pairs = other_words, None, None

    def rank_pairs(self, pairs: pa.Table, others: bytes | None) -> None:
        order = pairs.sort_by([("a", "descending"), ("code", "ascending")])
        self.pairs, self.other_pairs = order["code"].to_numpy(), others

    def dictionaries(self) -> dict[str, dict[bytes, int]]:
        out: dict[str, dict[bytes, int]] = {}
        for i, (lang, word) in enumerate(zip(self.lang, self.word)):
            out.setdefault(lang, {_GAP: -1})[word.encode()] = i
        return out


def _bits(bitmap: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (bitmap[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) > 0


def tally(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, count) of the distinct pairs of two arrays of ids."""
    near = (row < TILE * EDGE) & (col < TILE * EDGE)
    r, c = row[near], col[near]
    tile = (r // TILE * EDGE + c // TILE).astype(np.uint16)
    order = np.argsort(tile, kind="stable")
    cell = (r % TILE * TILE + c % TILE)[order]
    edges = np.searchsorted(tile[order], np.arange(EDGE * EDGE + 1))
    rows, cols, counts = [], [], []
    for t in np.flatnonzero(np.diff(edges)).tolist():
        part = cell[edges[t] : edges[t + 1]]
        if len(part) * SPARSE >= TILE * TILE:
            dense = np.bincount(part, minlength=TILE * TILE)
            at = np.flatnonzero(dense)
            n = dense[at]
        else:
            at, n = np.unique(part, return_counts=True)
        rows.append(t // EDGE * TILE + at // TILE)
        cols.append(t % EDGE * TILE + at % TILE)
        counts.append(n)
    at, n = np.unique(row[~near] << 32 | col[~near], return_counts=True)
    return np.concatenate([*rows, at >> 32]), np.concatenate([*cols, at & (2**32 - 1)]), np.concatenate([*counts, n])


class _Phrases:
    """Counts the phrases of ``size`` words (2 or 3) of one task."""

    def __init__(self, known: _Known, size: int):
        self.known, self.size, self.ids = known, size, known.dictionaries()
        self.head = len(known.word)
        self.bitmaps = [None if b is None else np.frombuffer(b, np.uint64) for b in (known.other_words, known.other_pairs)]
        if size == 3:
            self.by_code = np.argsort(known.pairs)
            self.codes = known.pairs[self.by_code]
        self._start()

    def _start(self) -> None:
        self.others: dict[str, dict[bytes, int]] = {}
        self.names: list[tuple[str, bytes]] = []
        self.seen = self.held = 0
        self.found: list[tuple[np.ndarray, np.ndarray]] = []  # first word or pair, next word
        self.triples: list[np.ndarray] = []  # phrases of three without a ranked first pair

    def _other(self, lang: str, word: bytes) -> int:
        """A word without an id: -1 if it is surely rare."""
        own = self.others.setdefault(lang, {})
        if word not in own:
            self.seen += 1
            p = zlib.crc32(lang.encode() + _GAP + word) % BITS
            if int(self.bitmaps[0][p >> 6]) >> (p & 63) & 1:
                own[word] = self.head + len(self.names)
                self.names.append((lang, word))
            else:
                own[word] = -1
        return own[word]

    def to_ids(self, lang: str, words: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.ids.get(lang, {_GAP: -1}).get, words, repeat(-2)), np.int64, len(words))
        strange = np.flatnonzero(ids == -2)
        if self.bitmaps[0] is None:
            ids[strange] = -1
        else:
            ids[strange] = [self._other(lang, words[i]) for i in strange.tolist()]
        return ids

    def add(self, ids: np.ndarray) -> None:
        """Count the phrases that lie in ``ids`` as a whole."""
        a, b = ids[:-1], ids[1:]
        ok = (a >= 0) & (b >= 0)
        if self.size == 2:
            self.found.append((a[ok], b[ok]))
            self.held += int(ok.sum())
            return
        code = np.where(ok, a << _SHIFT | b, -1)
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        ranked = ok & (self.codes[at] == code) if len(self.codes) else np.zeros(len(code), bool)
        strange = ok & ((a >= self.head) | (b >= self.head))
        may = ranked | strange
        if self.bitmaps[1] is not None:
            left = np.flatnonzero(ok & ~may)
            may[left[_bits(self.bitmaps[1], (a[left] * 1_000_003 + b[left]) % BITS)]] = True
        both = may[:-1] & may[1:]
        first = both & ranked[:-1] & (ids[2:] < self.head)
        self.found.append((self.by_code[at[:-1][first]], ids[2:][first]))
        rest = both & ~first
        self.triples.append(a[:-1][rest] << 2 * _SHIFT | b[:-1][rest] << _SHIFT | ids[2:][rest])
        self.held += int(both.sum())

    def full(self) -> bool:
        return self.held >= BLOCK or self.seen > OTHERS

    def done(self) -> Iterator[pa.RecordBatch]:
        """(code, lang, phrase, a): a code of ids from the dictionary, or language and text."""
        row, col, n = tally(*(np.concatenate(c) for c in zip(*self.found))) if self.found else (np.zeros(0, np.int64),) * 3
        code = (row if self.size == 2 else self.known.pairs[row]) << _SHIFT | col
        if self.triples:
            more, m = np.unique(np.concatenate(self.triples), return_counts=True)
            code, n = np.concatenate([code, more]), np.concatenate([n, m])
        parts = [code >> _SHIFT * k & _MASK for k in range(self.size)][::-1]
        strange = np.logical_or.reduce([p >= self.head for p in parts])
        plain = ~strange
        for lo in range(0, int(plain.sum()), 1 << 18):
            c, m = code[plain][lo : lo + (1 << 18)], n[plain][lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.nulls(len(c), pa.string()), pa.nulls(len(c), pa.string()), pa.array(m.astype(np.int64))], ["code", "lang", "phrase", "a"])
        langs, phrases = [], []
        for ids in zip(*(p[strange].tolist() for p in parts)):
            named = [self.names[i - self.head] if i >= self.head else (self.known.lang[i], self.known.word[i].encode()) for i in ids]
            langs.append(named[0][0])
            phrases.append(b" ".join(w for _, w in named))
        if langs:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(langs), pa.int64()), pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n[strange].astype(np.int64))],
                ["code", "lang", "phrase", "a"])
        self._start()


def _phrase_counts(rows: DataFrame, known: _Known, size: int) -> DataFrame:
    """(code, lang, phrase, a) of all phrases of ``size`` words that may be frequent."""
    told = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Phrases(told.value, size)
        for batch in batches:
            for lang, lists in _chunks(batch):
                before: list[bytes] = []
                for words in lists:
                    words = before + words
                    count.add(count.to_ids(lang, words))
                    before = words[len(words) - size + 1 :] if len(words) >= size else words
                    if count.full():
                        yield from count.done()
        yield from count.done()

    found = rows.mapInArrow(lean(run), "code bigint, lang string, phrase string, a bigint")
    return found.groupBy("code", "lang", "phrase").agg(F.sum("a").alias("a"))


def _named(found: DataFrame, head: DataFrame, size: int) -> DataFrame:
    """(lang, w1 ... w<size>, a): the words in place of codes; ``head`` (id, lang, word) is broadcast."""
    coded, texts = found.where("code is not null"), found.where("code is null")
    for k in range(size):
        name = f"w{k + 1}"
        at = head.select(F.col("id").alias("_id"), F.col("word").alias(name), *([F.col("lang").alias("_lang")] if k == 0 else []))
        part = F.shiftright("code", _SHIFT * (size - 1 - k)).bitwiseAND(F.lit(_MASK))
        coded = coded.join(F.broadcast(at), part == F.col("_id")).drop("_id")
    words = [F.split("phrase", " ", -1)[k].alias(f"w{k + 1}") for k in range(size)]
    return coded.select(F.col("_lang").alias("lang"), *[f"w{k + 1}" for k in range(size)], "a").union(texts.select("lang", *words, "a"))


def _join(left: DataFrame, right: DataFrame, on: dict[str, str], value: str, out: str, how: str = "inner") -> DataFrame:
    """``left`` with ``right``'s ``value`` as ``out``, by lang and the columns of ``on`` (left name: right name)."""
    keys = {"lang": "lang"} | on
    r = right.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keys.values())], F.col(value).alias(out))
    test = [F.col(c) == F.col(f"_{i}") for i, c in enumerate(keys)]
    return left.join(r, test, how).drop(*[f"_{i}" for i in range(len(keys))])


def _score(l: str, r: str) -> Column:
    """floor(1000000 a a / (l r)), exact: products have up to 38 digits."""
    wide = lambda c: f"cast({c} as decimal(16,0))"
    return F.expr(f"cast(1000000 as decimal(7,0)) * ({wide('a')} * {wide('a')}) div ({wide(l)} * {wide(r)})").cast("bigint")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = 10, most: int = 2000, share: int = 50,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` phrases of two and three words of each language.

    A-Z are lower-cased; texts are cut into pieces at marks and line breaks and into words at blanks and tabs. A
    phrase of at least ``min_count`` occurrences (a) is cut in two where 1000000 a a / (l r), rounded down, is
    least (ties: the earlier cut); l and r are the occurrences of its parts, n those of all words of the
    language. A pair that lies in a phrase of three words which occurs at least ``share`` % as often is dropped. Order: score and a
    descending, then the phrase by bytes. A null text is empty, a null language is ``und``. No rows give no
    rows; repeated rows count again, other columns play no part. Texts are read three times.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    counts = written(_word_counts(rows), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counts.where(F.col("n") >= min_count)
    border = _border(words, "n", HEAD)
    place = F.crc32(F.concat(F.col("lang").cast("binary"), F.unhex(F.lit("FF")), F.col("word").cast("binary"))) % BITS
    others = words.where(F.col("n") < border)
    known = _Known(words.where(F.col("n") >= border).toArrow(), _bitmap(others.select(place.alias("p"))) if others.limit(1).count() else None)
    ids = pa.table({"id": pa.array(range(len(known.word)), pa.int64()), "lang": pa.array(known.lang, pa.string()), "word": pa.array(known.word, pa.string())})
    head = written(spark.createDataFrame(ids), "ids")

    two = written(_phrase_counts(rows, known, 2).where(F.col("a") >= min_count), "pairs")
    coded = two.where("code is not null")
    border = _border(coded, "a", PAIRS)
    behind = coded.where(F.col("a") < border)
    code = F.shiftright("code", _SHIFT) * 1_000_003 + F.col("code").bitwiseAND(F.lit(_MASK))
    known.rank_pairs(coded.where(F.col("a") >= border).select("code", "a").toArrow(), _bitmap(behind.select((code % BITS).alias("p"))) if behind.limit(1).count() else None)
    counted = written(_phrase_counts(rows, known, 3).where(F.col("a") >= min_count), "triples")  # read by two branches
    three = written(_named(counted, head, 3), "named-triples")
    pairs = written(_named(two, head, 2), "named-pairs")

    part = _join(_join(three, words, {"w1": "word"}, "n", "l1"), pairs, {"w2": "w1", "w3": "w2"}, "a", "r1")
    part = _join(_join(part, pairs, {"w1": "w1", "w2": "w2"}, "a", "l2"), words, {"w3": "word"}, "n", "r2")
    scored = part.withColumns({"s1": _score("l1", "r1"), "s2": _score("l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    of_three = scored.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    inside = three.select("lang", "w1", "w2", "a").union(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = inside.groupBy("lang", "w1", "w2").agg(F.max("a").alias("m"))
    free = _join(pairs, longer, {"w1": "w1", "w2": "w2"}, "m", "longer", "left").where(F.coalesce(100 * F.col("longer"), F.lit(0)) < F.lit(share) * F.col("a"))
    of_two = _join(_join(free, words, {"w1": "word"}, "n", "l"), words, {"w2": "word"}, "n", "r").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("l", "r").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = of_two.union(of_three).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most)
    return _join(best, totals, {}, "n", "n").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
