"""Fingerprints, edited texts and every column of the query against a count by hand."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from labelrank.llm import simhash
from labelrank.llm.queries import op9_simhash_fingerprints

LONG = "the old mill by the river turned all night long while nobody slept and rain fell on every roof " * 12_000  # 1.1 MB
TEXTS = [
    (1, "one two three four five six seven"), (2, None), (3, ""), (4, "short"), (5, " \n\t"), (6, "a b c d e"), (7, "Größe ÜBER ß " * 40), (8, "a b c d e"),
    (9, "word " * 500), (10, " ".join(f"w{i % 37}" for i in range(901))), (11, "no"), (12, "x" * 900), (13, LONG), (14, LONG[:400_000]), (15, "three wee words"),
    (None, "nothing known"), (100, " ".join(f"w{i % 37}" for i in range(900))), (200, "four words and more of them here, enough to vote on it"), (8, "a b c d e"),
]


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def fingerprint(text):
    hashes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.split("[\x20\x09-\x0D]+", (text or "").lower()) if w]
    hashes += [0] * (5 - len(hashes))
    votes, n = [0] * 64, len(hashes) - 4
    for i in range(n):
        h = 42
        for w in hashes[i : i + 5]:
            h = xxhash.xxh64(w.to_bytes(8, "little"), seed=h).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum((2 * v > n) << b for b, v in enumerate(votes))


def likeness(a, b):
    return 1 - (a ^ b).bit_count() / 64


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "w") for i, t in TEXTS], "doc_id bigint, text string, n int, words string").repartition(3)


def test_fingerprints(spark, docs):
    out = simhash.fingerprints(docs.where("doc_id is not null").distinct(), ["doc_id"]).collect()
    assert {r["doc_id"]: r["fingerprint"] % 2**64 for r in out} == {i: fingerprint(t) for i, t in TEXTS if i is not None}


def expected(rows):
    order = sorted({(i if i is not None else -(2**63), t or "") for i, t in rows}, reverse=True)
    out = []
    prints = {(i, t): fingerprint(t) for i, t in order}
    per_row = {}
    for at, (i, t) in enumerate(order):
        nxt = order[(at + 1) % len(order)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[1][:cut]
        own, edit = prints[i, t], fingerprint(edited)
        per_row[i, t] = (None if i == -(2**63) else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{own:016x}", f"{edit:016x}", likeness(own, edit), likeness(own, prints[nxt]))
    for i, t in rows:
        key = (i if i is not None else -(2**63), t or "")
        near = sum((prints[key] ^ prints[j if j is not None else -(2**63), u or ""]).bit_count() <= 3 for j, u in rows) - 1 if i is not None and i % 100 == 0 else None
        out.append((*per_row[key], near))
    return sorted(out, key=str)


def check(spark, folder):
    out = op9_simhash_fingerprints(spark, str(folder)).collect()
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")
    return sorted((tuple(r[c] for c in names) for r in out), key=str)


def test_query_equals_a_count_by_hand(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert check(spark, tmp_path) == expected(TEXTS)


def test_query_on_the_given_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check(spark, sf_dir) == expected(rows)


def test_empty(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert check(spark, tmp_path) == []


def test_no_python_worker(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = simhash.edit_fingerprints(simhash.edits(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
