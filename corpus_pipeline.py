"""From documents to token ids: quality, near duplicates, benchmark passages, mixture, binary output.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelrank.llm import contamination, mixing, ngramjoin, quality, tokenids
from labelrank.llm.tables import crc_fold, written
from labelrank.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labelled ones in four of five folds."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    stats = quality.statistics(docs.where(crc_fold() != 0).select("doc_id", "text"))  # only these narrow rows are joined
    known = stats.join(labels.where("label is not null"), F.col("doc_id") == F.col("_id"))
    return quality.keep(docs, quality.fit(known.select("doc_id", "statistics", "label")), threshold=0.3)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class whose runs of five words have a similarity of 0.8 or more."""
    return ngramjoin.one_of_each(docs, width=5, similarity=Fraction(4, 5))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return contamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the numbers that the mixture of sources takes; n_chars follows the text of a partial copy."""
    mixed = mixing.materialize(docs, written(mixing.mix(docs), "mixture"))
    return mixed.withColumn("n_chars", F.length("text").cast("bigint"))


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixture as binary shards, read back: per document start, number and checksum of its ids."""
    folder = scratch_path(spark, "token-ids")
    tokenids.write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return tokenids.read_documents(spark, folder)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixture),
    ("token-ID output", token_shards),
]

#: Classifier and tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table of documents."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
