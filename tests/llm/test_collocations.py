"""Collocations against brute force and SQL, with everything behind the ranks, too."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelrank.llm import collocations

from __spark_entry__ import oracle_sql, queries
from tests.oracle import connect, mismatch


def brute(rows, least=10, most=2000, share=50):
    out = []
    per = defaultdict(list)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        per[lang or "und"] += [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]
    for lang, pieces in per.items():
        f = Counter(tuple(p[i : i + m]) for p in pieces for m in (1, 2, 3) for i in range(len(p) - m + 1))
        n = sum(c for w, c in f.items() if len(w) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, l, rr, n, -s) for r, (s, a, p, l, rr) in enumerate(sorted(ranked)[:most])]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Größe", "naïve", " ", "a\x00b", "ÀB"]
    out = []
    for d in range(60):
        text = []
        for _ in range(120):
            text.append(rng.choice([" ", "  ", "\t", " ", ". ", ", ", "\n", " "]) + rng.choice([words[int(rng.paretovariate(0.5)) % len(words)], "New York city", "of the", "of the most", "New York"]))
        out.append((rng.choice(["en", "en", "de", None, "und"]), "".join(text)))
    return out + [("en", None), ("en", ""), ("fr", "x " * 9), ("it", "so so so so so so so so so so so so"), (None, " . , "), ("en", "tail tale told " * 700)] + [("en", "copy of copy")] * 20


@pytest.mark.parametrize("small", [{}, {"HEAD": 12, "PAIRS": 8, "CHUNK": 64, "BLOCK": 100, "OTHERS": 5, "COUNTED": 10}, {"HEAD": 0, "PAIRS": 0}, {"PAIRS": 0, "SPARSE": 1 << 20}])
def test_equals_brute_force(spark, rows, small, monkeypatch):
    for name, value in small.items():
        monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame([(i, *r, 1, "p") for i, r in enumerate(rows)], "doc_id bigint, lang string, text string, a int, phrase string").repartition(3)
    expected = brute(rows)
    assert found(collocations.collocations(docs)) == expected and len(expected) > 90
    few = brute(rows, 4, 7, 80)
    assert found(collocations.collocations(docs, min_count=4, most=7, share=80)) == few


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


def test_long_text(spark, rows):
    text = " ".join(t for _, t in rows if t)
    text *= collocations.CHUNK * 3 // 2 // len(text)
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    assert found(collocations.collocations(docs)) == brute([("en", text)])


def test_exact_beyond_64_bits(spark):
    a, l, r = 10**13 + 7, 10**15 + 3, 10**13 + 9
    row = spark.createDataFrame([(a, l, r)], "a bigint, l bigint, r bigint").select(collocations._score("l", "r").alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (l * r)


def test_split(monkeypatch):
    data = b"a bb ccc\xffdddddddddddddddddd e\xff\xff f " * 5
    whole = data.replace(b"\xff", b" \xff ").split()
    for size in (1, 2, 5, 9, 200):
        monkeypatch.setattr(collocations, "CHUNK", size)
        assert [w for words in collocations._split(data) for w in words] == whole


def test_tally():
    rng = np.random.default_rng(1)
    row, col = (rng.zipf(1.2, 200_000) - 1) % 100_000, (rng.zipf(1.3, 200_000) - 1) % 100_000
    got = {(r, c): n for r, c, n in zip(*(x.tolist() for x in collocations.tally(row, col)))}
    assert got == Counter(zip(row.tolist(), col.tolist()))


def test_query_equals_sql(spark, sf_dir):
    name = "op13_phrase_collocations"
    assert mismatch(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name]) is None
