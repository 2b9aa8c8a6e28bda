"""Every operator against brute force on small tables that hold nulls, empty texts, repeated rows and other columns."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from labelrank.llm import contamination, langid, mixing, ngramjoin, quality, repeats, simhash, tokencount, tokenids, urlfilter
from labelrank.llm.intervals import repeated
from labelrank.llm.prefixtree import linked
from labelrank.llm.wavelet import WaveletMatrix
from labelrank.session import scratch_path

SCHEMA = "doc_id bigint, text string, lang string, source string, score double, anchor string, side int"
BASE = "the quick brown fox jumps over the lazy dog and runs through the old forest until night falls over the quiet hills "
TEXTS = [
    (0, BASE * 3), (1, BASE * 3 + "again"), (2, "Größe über ALLES. " * 30), (3, None), (4, ""), (5, "  \n\t "), (6, "a"), (7, "x y"),
    (8, "un deux trois quatre cinq six sept huit neuf dix " * 8), (9, BASE.upper() * 3), (9, BASE.upper() * 3), (None, "lost and found"),
    (11, "lost and found"), (12, "1234 !!! <|endoftext|> '' ▁ \x00 ﬁ é"), (13, " ".join(f"w{i}" for i in range(3000))),
    (14, " ".join(f"w{i}" for i in range(2990))), (15, "ab" * 400), (16, "line one\nline two\n\nline one\n" * 20),
]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ("fr" if t and "deux" in t else "de" if t and "Gr" in t else "en") if i != 12 else None, f"s{(i or 0) % 3}" if i != 8 else None, 0.5, "x", 1) for i, t in TEXTS]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def words(text, lower=True):
    found = re.findall("[^\x20\x09-\x0d]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found] if lower else found


def test_language(docs, none):
    model = langid.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()}
    assert {(0, "en"), (2, "de"), (8, "fr"), (3, "und"), (4, "und"), (5, "und")} <= got
    assert all(0 <= r.score <= 1 for r in langid.predict(docs, model).collect())
    assert langid.predict(docs, model).count() == len(TEXTS) and langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}


def test_token_ids(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    folder = scratch_path(spark, "test-ids")
    tokenids.write_shards(docs, folder, path, shard_tokens=50)
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    want, start = Counter(), 0
    for i, t in order:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], np.uint32)
        want[i, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert bag(tokenids.read_documents(spark, folder)) == want
    empty = scratch_path(spark, "test-ids")
    tokenids.write_shards(none, empty, path)
    assert tokenids.read_documents(spark, empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    a = np.random.default_rng(n).integers(0, 70_000, n) % 500
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(a).to_bytes())
    assert (w.tokens() == a).all() and w.count(499_999) == 0
    for i in range(0, n, 29):
        k = int((a[:i] == a[i]).sum())
        assert w.access(i) == a[i] and w.count(int(a[i]), 0, i) == k and w.find(int(a[i]), k) == i
    with pytest.raises(IndexError):
        w.access(n)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(docs, none, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        from tokenizers import Tokenizer

        library = lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    want = Counter()
    for i, t in TEXTS:
        n = len(library(t or ""))
        want[i, len((t or "").encode()), n, n > 100] += 1
    assert bag(tokencount.token_counts(docs, path, limit=100)) == want
    assert tokencount.token_counts(none, path).count() == 0


def test_mixing(docs, none):
    mixed = mixing.mix(docs)
    got = [r.asDict() for r in mixed.collect()]
    assert len(got) == len(TEXTS) and bag(mixed) == bag(mixing.mix(docs.repartition(7)))
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s or "")), [5, 2, 1] * 9))
    target, fixed = {}, {}
    while True:  # reshare what is above the cap
        open_ = [s for s in sizes if s not in fixed]
        level = (sum(sizes.values()) - sum(fixed.values())) / sum(weights[s] for s in open_)
        target = {**fixed, **{s: weights[s] * level for s in open_}}
        over = {s: 3.0 * sizes[s] for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            break
        fixed.update(over)
    for s, v in by.items():
        assert v[0]["source_size"] == sizes[s] and v[0]["target"] == pytest.approx(target[s])
        assert sum(r["taken"] for r in v) == round(target[s])
    out = mixing.materialize(docs, mixed)
    assert out.columns == docs.columns
    taken = Counter({s: sum(r["taken"] for r in v) for s, v in by.items()})
    assert Counter({r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.words_of()).alias("n")).collect()}) == taken
    assert mixing.mix(none).count() == 0


def classes_of(texts, width, num, den):
    sets = []
    for _, t in texts:
        w = words(t)
        sets.append({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    out = Counter()
    for k, (i, _) in enumerate(texts):
        ids = [a for (a, _), r in zip(texts, root) if r == root[k] and a is not None]
        out[i, len(sets[k]), min(ids) if ids else None] += 1
    return out


@pytest.mark.parametrize("block", [100, 100_000])
@pytest.mark.parametrize("width, similarity", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_ngram_join(docs, none, monkeypatch, width, similarity, block):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    assert bag(ngramjoin.classes(docs, width=width, similarity=similarity)) == classes_of(TEXTS, width, similarity.numerator, similarity.denominator)


def test_one_of_each(docs, none):
    kept = ngramjoin.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 5, 6, 7, 8, 11, 12, 13, 15, 16]
    assert ngramjoin.classes(none).count() == 0 and ngramjoin.one_of_each(none).count() == 0


def test_prefix_tree():
    rng = np.random.default_rng(2)
    for t in range(60):
        base = [rng.integers(0, 60, rng.integers(0, 25)) for _ in range(4)]
        sets = []
        for _ in range(int(rng.integers(1, 30))):
            b = base[rng.integers(0, 4)].copy()
            b[: len(b) // 8] = rng.integers(0, 60, len(b) // 8)
            sets.append(np.unique(b).astype(np.uint64))
        side = np.zeros(len(sets), int) if t % 2 else rng.integers(0, 2, len(sets))
        num, den = [(9, 10), (4, 5), (1, 2)][t % 3]
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and (not side.any() or side[i] != side[j])
                 and den * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j]))]

        def roots(links):
            r = list(range(len(sets)))
            for a, b in links:
                r = [min(r[a], r[b]) if x in (r[a], r[b]) else x for x in r]
            return r

        got = linked(sets, side, num, den)
        assert all((max(p), min(p)) in pairs for p in got) and roots(got) == roots(pairs)


def test_quality(spark, docs, none):
    junk = [(100 + i, "BUY NOW!!! $$$ ### " * (i + 1), "en", "s", 0.5, "x", 0) for i in range(40)]
    good = [(200 + i, "It was a quiet day, and nothing much happened in the town. " * (i + 1), "en", "s", 0.5, "x", 1) for i in range(40)]
    train = spark.createDataFrame(junk + good, SCHEMA)
    forest = quality.fit(quality.statistics(train), label="side")
    scored = quality.score(quality.statistics(train), forest)
    assert scored.columns == ["doc_id", "lang", "source", "anchor", "side", "score"]
    assert all((r.score >= 0.3) == (r.side == 1) for r in scored.collect())
    assert {r.doc_id for r in quality.keep(train, forest).collect()} == {200 + i for i in range(40)}
    every = quality.score(quality.statistics(docs), forest).collect()
    assert len(every) == len(TEXTS) and all(0 <= r.score <= 1 for r in every)
    blank = quality.fit(quality.statistics(none), label="side")
    assert {r.score for r in quality.score(quality.statistics(docs), blank).collect()} == {0.5}
    assert quality.score(quality.statistics(none), forest).count() == 0


def test_url_filters(spark):
    entries = spark.createDataFrame([
        ("block", "bad.com", "2020-01-10", "add"), ("block", "bad.com", "2020-02-01", "remove"), ("block", "bad.com", "2020-03-01", "add"),
        ("block", "bad.com", "2020-03-05", "add"), ("allow", "good.bad.com", "2020-01-01", "add"), ("block", "shop.org/ads", "2020-01-01", "add"),
        ("block", "same.net", "2020-01-05", "add"), ("block", "same.net", "2020-01-05", "remove"), ("block", None, "2020-01-01", "add"),
    ], "list string, key string, day string, action string").withColumn("day", F.to_date("day"))
    active = urlfilter.intervals(entries)
    assert {(r.key, str(r.since), str(r.until)) for r in active.where("list = 'block'").collect()} == {
        ("bad.com", "2020-01-10", "2020-02-01"), ("bad.com", "2020-03-01", "None"), ("shop.org/ads", "2020-01-01", "None")}
    rows = [
        (1, "http://www.BAD.com./a", "2020-01-09", True), (2, "http://www.bad.com/a", "2020-01-10", False), (3, "http://bad.com", "2020-01-31", False),
        (4, "http://bad.com", "2020-02-01", True), (5, "http://bad.com:80/x?y", "2021-01-01", False), (6, "https://good.bad.com/z", "2020-01-15", True),
        (7, "https://u@shop.org/ads/1.html", "2020-05-05", False), (8, "https://shop.org/news", "2020-05-05", True), (9, "http://same.net/", "2020-01-06", True),
        (10, None, "2020-01-15", True), (11, "no address", "2020-01-15", True), (12, "http://bad.com", None, True), (2, "http://www.bad.com/a", "2020-01-10", False),
    ]
    caps = spark.createDataFrame([r[:3] for r in rows], "id bigint, url string, day string").withColumn("day", F.to_date("day"))
    got = urlfilter.evaluate(caps, active, "id", "url", "day")
    assert Counter((r.capture_id, r.kept) for r in got.collect()) == Counter((r[0], r[3]) for r in rows)
    assert urlfilter.evaluate(caps.limit(0), active, "id", "url", "day").count() == 0
    assert urlfilter.evaluate(caps, active.limit(0), "id", "url", "day").where("kept").count() == len(rows)


def test_url_filters_of_deep_paths(spark):
    entries = spark.createDataFrame([
        ("block", "a.org/x/y/z", "2020-01-01", "add"), ("block", "b.org", "2020-01-01", "add"), ("allow", "b.org/1/2/3/4/5", "2020-01-01", "add"),
    ], "list string, key string, day string, action string").withColumn("day", F.to_date("day"))
    rows = [
        (1, "http://a.org/x/y/z/page.html", False, 1), (2, "http://a.org/x/y/z", False, 1), (3, "http://a.org/x/y", True, 0), (4, "http://a.org/x/y/zz", True, 0),
        (5, "http://b.org/1/2/3/4/5/6?q", True, 2), (6, "http://b.org/1/2/3/4", False, 1), (7, "http://a.org", True, 0),
    ]
    caps = spark.createDataFrame([r[:2] for r in rows], "id bigint, url string").withColumn("day", F.to_date(F.lit("2020-05-05")))
    got = urlfilter.evaluate(caps, urlfilter.intervals(entries), "id", "url", "day")
    assert Counter((r.capture_id, r.kept, r.n_active) for r in got.collect()) == Counter((r[0], *r[2:]) for r in rows)
    [keys] = caps.where("id = 2").select(urlfilter.keys_of(F.col("url")).alias("keys")).collect()
    assert set(keys["keys"]) == {"a.org", "a.org/x", "a.org/x/y", "a.org/x/y/z"}


@pytest.mark.parametrize("block", [30, 1 << 20])
def test_contamination(spark, docs, none, block):
    items = spark.createDataFrame(
        [(1, "The QUICK brown fox, jumps over the lazy dog and runs!"), (2, "un deux trois quatre cinq six sept huit"), (3, None), (4, ""), (5, "x y"),
         (6, "the quick brown fox jumps over some other animal that is not here at all"), (7, "lost")], "item_id bigint, text string")
    got = contamination.contained_items(docs, items, block_bytes=block)
    assert Counter((r.doc_id, r.item_id) for r in got.collect()) == Counter([(0, 1), (1, 1), (9, 1), (9, 1), (8, 2), (7, 5)])
    assert all(r.containment >= 0.8 for r in got.collect())
    clean = contamination.decontaminate(docs, items, block_bytes=block)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in TEXTS} - {0, 1, 9, 8, 7}
    assert contamination.contained_items(none, items).count() == 0 and contamination.contained_items(docs, items.limit(0)).count() == 0


def test_fingerprints(docs, none):
    edited = simhash.edits(docs)
    order = sorted({((-(2**63) if i is None else i), t or "") for i, t in TEXTS}, reverse=True)
    # repeated ids hold equal texts here, so the order by hash doesn't matter
    want = {}
    for k, (i, t) in enumerate(order):
        n = len(t) // 3
        want[i] = t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]
    assert Counter((r._k, r.edited) for r in edited.collect()) == Counter(
        ((-(2**63) if i is None else i), want[-(2**63) if i is None else i]) for i, _ in TEXTS)
    prints = {r._k: r.fingerprint for r in simhash.fingerprints(edited, ["_k", "_h"]).collect()}
    assert prints[3] == prints[4] == prints[5] and prints[11] == prints[-(2**63)] and prints[0] == prints[9] != prints[2]
    assert simhash.edits(none).count() == 0


def test_block_tables(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    near = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False))) for b in base for _ in range(3)]
    prints = spark.createDataFrame([(int(p),) for p in [*base, *near]] + [(None,)], "fingerprint bigint")
    every = {int(p) for p in [*base, *near]}
    for radius, blocks in ((3, 6), (0, 1), (2, 4)):
        got = {(r.fingerprint, r.match): r.distance for r in simhash.search(prints, prints, radius, blocks).collect()}
        want = {(a, b): d for a in every for b in every if (d := ((a ^ b) & (2**64 - 1)).bit_count()) <= radius}
        assert got == want


def without_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        yield len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("length, gram, group", [(200, 64, 20_000), (20, 8, 20_000), (20, 8, 1)])
def test_repeats(docs, none, length, gram, group):
    got = repeats.remove_repeats(docs, length=length, gram=gram, group=group).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert bag(got) == Counter((i, *r) for (i, _), r in zip(TEXTS, without_repeats([t for _, t in TEXTS], length)))
    assert repeats.remove_repeats(none).count() == 0


def same_short_hash(spark, a, b):
    """Both texts have one 32-bit hash."""
    found = spark.createDataFrame([(a,), (b,)], "text string").select(F.hash("text").alias("h")).distinct()
    return a != b and found.count() == 1


def test_rows_without_id_are_told_apart_by_repeats(spark):
    shared = " ".join(f"shared{i}" for i in range(30))
    a, b = f"long text 6831 {shared}", "short 63279"
    assert same_short_hash(spark, a, b)
    texts = [(None, a), (None, b), (1, shared)]
    got = repeats.remove_repeats(spark.createDataFrame(texts, "doc_id bigint, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert bag(got) == Counter((i, *r) for (i, _), r in zip(texts, without_repeats([t for _, t in texts], 200)))


def test_rows_without_id_are_told_apart_by_classes(spark):
    ten, six = "one two three four five six seven eight nine ten", "red green blue black white grey"
    a, b = f"{ten} 6696", f"{six} 382965"
    assert same_short_hash(spark, a, b)
    texts = [(None, a), (None, b), (5, f"{ten} other"), (6, f"{six} other")]
    got = ngramjoin.classes(spark.createDataFrame(texts, "doc_id bigint, text string"), width=1, similarity=Fraction(1, 2))
    assert bag(got) == classes_of(texts, 1, 1, 2)
    twice = spark.createDataFrame([(None, a), (None, b)] * 2, "doc_id bigint, text string")
    assert bag(ngramjoin.one_of_each(twice)) == Counter([(None, a), (None, b)])


def test_interval_expansion():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = rng.integers(0, rng.integers(1, 4) + 1, rng.integers(1, 200)).astype(np.uint16)
        n, length = len(a), int(rng.integers(1, 12))
        seen = Counter(a[i : i + length].tobytes() for i in range(n - length + 1))
        want = [i <= n - length and seen[a[i : i + length].tobytes()] > 1 for i in range(n)]
        assert repeated(a, length).tolist() == want
