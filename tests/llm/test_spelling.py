"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelrank.llm import spelling

from __spark_entry__ import queries

RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_counts(rows, min_length, rare):
    out = Counter()
    for doc, text in rows:
        for run in RUNS.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % rare == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                out[run] += 1
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, min_length=6, min_count=5, rare=199, ratio=5):
    n = {w: c for w, c in brute_counts(rows, min_length, rare).items() if c >= min_count}
    by_hole, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by_hole[w[:i] + "\0" + w[i + 1 :]].add(w)
            by_hole["-" + w[:i] + w[i + 1 :]].add(w)
        by_hole["-" + w].add(w)
    for group in by_hole.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda b: (-n[b], b), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("aeinorstüß") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words = []
    for w in base:
        words += [w] * rng.choice([2, 30, 200])
        for _ in range(6):
            v = list(w)
            at = rng.randrange(len(v))
            rng.choice([lambda: v.pop(at), lambda: v.insert(at, rng.choice("aeixé")), lambda: v.__setitem__(at, rng.choice("oszx"))])()
            words += ["".join(v)] * rng.choice([1, 5, 6, 40])
    words += ["wanders"] * 250 + ["wandrs"] * 40 + ["wandxs"] * 6  # a chain of forms
    rng.shuffle(words)
    out = [(i, " ".join(words[i::40])) for i in range(40)]
    out += [(40, None), (41, ""), (42, "ÜBERALL überall ×÷×÷×÷×÷"), (None, "nowhere " * 7), (None, "nowhere " * 3), (43, "x" * 5000 + " " + "y" * 4999), (7, out[7][1])]
    out += [(50 + i, "x" * 5000 + ". " + "x" * 4999 + "z " + "x" * 4999) for i in range(5)]
    return out


def test_variants(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id bigint, text string, n int, word string").repartition(4)
    expected = brute(rows)
    assert found(spelling.variants(docs)) == expected
    assert sum(r[1] is not None for r in expected) > 30 and any(r[2] != r[1] for r in expected if r[1])


def test_many_cells(spark, rows, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 7)
    monkeypatch.setattr(spelling, "LEAF", 2)
    words = sorted(brute_counts(rows, 3, 3))
    vocabulary = spark.createDataFrame([(w, len(w)) for w in words], "word string, n bigint")
    trees = spelling._trees(vocabulary.selectExpr("word", "n", "cast(length(word) as bigint) length"))
    assert max(int((t.place < 0).sum()) for t in trees.values()) > 5
    pairs = sorted((r["word"], r["near"], r["near_n"]) for r in spelling.near_words(vocabulary).collect())
    assert pairs == sorted((a, b, len(b)) for a in words for b in words if one_edit(a, b))


def test_box_distance():
    rng = np.random.default_rng(0)
    data, asked = rng.integers(0, 3, (300, spelling.PLACES)), rng.integers(0, 3, (40, spelling.PLACES))
    data[:40] = asked
    data[np.arange(40), rng.integers(0, 32, 40)] += 1
    got = {(int(a), int(b)) for q, d in spelling.box_pairs(data, asked, 1, 1) for a, b in zip(q, d)}
    diff = data[None] - asked[:, None]
    want = set(zip(*map(np.ndarray.tolist, np.nonzero((np.maximum(diff, 0).sum(2) <= 1) & (np.maximum(-diff, 0).sum(2) <= 1)))))
    assert got == want and len(want) >= 40


def test_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 5)
    for text in ("", "abc", "abcdefghijkl mn opq r", "ab1cd2ef3", "é" * 30):
        parts = list(spelling._pieces(text))
        assert "".join(parts) == text and [w for p in parts for w in RUNS.findall(p)] == RUNS.findall(text)


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id bigint, text string")).count() == 0


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(queries()["op11_spelling_variants"](spark, sf_dir)) == brute(rows)
