"""The pipeline's stages one after the other, each against what its predecessor kept, and queries beside their SQL."""

import corpus_pipeline
import pytest

from __spark_entry__ import oracle_sql, queries
from tests.oracle import connect, mismatch

SQL = ["op4_mix_sources", "op7_url_filters", "op8_benchmark_decontamination"]


@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, sf_dir, name):
    assert mismatch(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name]) is None


def test_every_dealt_query_is_there():
    assert {int(q[2:].split("_")[0]) for q in queries() if q.startswith("op") and q[2].isdigit()} == set(range(1, 14))
    assert "pipeline" in queries()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(out.columns) == sorted(docs.columns), name
            assert dict(out.dtypes) == dict(docs.dtypes), name
        docs = corpus_pipeline.written(out, "test-stage")
        counts.append(docs.count())
    assert 0 < counts[2] <= counts[1] <= counts[0] < 200 and counts[4] == counts[3] > 0
    assert queries()["pipeline"](spark, sf_dir).count() == counts[4]


def test_stages_take_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        docs = docs if "text" not in out.columns else out
