"""Exact duplicates against plain grouping, with nulls, long and repeated texts, repeated ids and clashing names."""

import hashlib
from collections import defaultdict

import pytest

from labelrank.llm import exactdedup
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tests.oracle import connect, mismatch

LONG = "all work and no play " * 80_000  # 1.7 MB
ROWS = [
    (1, "a b", 1), (2, "a b", 2), (3, "b a", 3), (4, None, 4), (5, "", 5), (6, "x" * 300 + "1", 6), (7, "x" * 300 + "2", 7), (8, "x" * 300 + "1", 8),
    (9, LONG, 9), (10, LONG, 10), (11, LONG[:-1] + "!", 11), (12, "alone, of its own length", 12), (13, "é", 13), (14, "é", 14), (15, "ab", 15),
    (2, "a b", 16), (None, "a b", 17), (None, "n", 18), (None, "n", 19), (None, "A B", 20),
] + [(100 + i, "hot", 0) for i in range(60)]
SCHEMA = "doc_id bigint, text string, _full int"


def brute(rows, normalise=lambda t: t):
    held = defaultdict(list)
    for i, t, *_ in rows:
        held[normalise(t or "")].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in held.items()}
    return sorted(((i, best[normalise(t or "")], len(held[normalise(t or "")])) for i, t, *_ in rows), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


def test_groups(docs):
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    out = exactdedup.groups(docs, carry={"sha": digest}).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in out), key=str) == brute(ROWS)
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len({r["sha"] for r in out}) == len({r["sha"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert sorted(r["sha"] for r in out) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in ROWS)


def test_normalised_and_short_prefix(docs):
    out = exactdedup.groups(docs, normalise=F.lower, prefix=1).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in out), key=str) == brute(ROWS, str.lower)


def test_one_of_each_keeps_columns(docs):
    out = exactdedup.one_of_each(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    rows = out.collect()
    assert sorted(r["text"] or "" for r in rows) == sorted({t or "" for _, t, _ in ROWS})
    assert {r["doc_id"] for r in rows} >= {2, 8, 10, 11, 159, 5, 12, None} and not {r["doc_id"] for r in rows} & {1, 4, 6, 9, 100}


def test_empty(docs):
    assert exactdedup.groups(docs.limit(0)).count() == 0 and exactdedup.one_of_each(docs.limit(0)).count() == 0


def test_no_python_worker(docs):
    plan = exactdedup.groups(docs)._jdf.queryExecution().toString() + exactdedup.one_of_each(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Window" not in plan


def test_full_hash_only_of_survivors(docs):
    rows = exactdedup._rows(docs, "text", None, _id=F.col("doc_id"))
    hashed = {r["_id"]: r["_full"] is not None for r in exactdedup._survivors(rows, 128).collect()}
    assert hashed[9] and hashed[6] and not hashed[12] and not hashed[3]


def test_query_equals_sql(spark, sf_dir):
    name = "op12_exact_dedup"
    assert mismatch(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name]) is None
