from __future__ import annotations

from pyspark.sql import functions as F

from labelrank.operators import split
from labelrank.queries.base import query, sql_hash, table

_H = sql_hash(42, "o_orderkey")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("label"))


_O = "o as (select o_orderkey, cast(year(o_orderdate) as int) season, o_orderstatus as label, o_totalprice from orders)"


@query(f"""with {_O}
select o_orderkey, season, label, case when season between 1995 and 1999 then 'train' else 'test' end part
from o where season between 1995 and 1999 or season in (2000, 2001)""")
def temporal_split(spark, sf_dir):
    return split.temporal_split(_orders(spark, sf_dir), (1995, 1999), [2000, 2001])


@query(f"with {_O} select o_orderkey, label, {_H} / 4294967296.0::double < 0.2 is_test from o")
def holdout_split(spark, sf_dir):
    return split.holdout(_orders(spark, sf_dir).select("o_orderkey", "label"), "o_orderkey")


_STRATIFIED = f"""with {_O}
select o_orderkey, label, row_number() over (partition by label order by {_H}, o_orderkey)
       <= round(0.2 * count(*) over (partition by label)) is_test from o"""


@query(_STRATIFIED)
def stratified_split(spark, sf_dir):
    return split.stratified_holdout(_orders(spark, sf_dir).select("o_orderkey", "label"), "label", "o_orderkey")


@query(_STRATIFIED)
def stratified_split_bucketed(spark, sf_dir):
    """Small buckets, so that the split goes through the bucket counts as it would on a large table."""
    rows = _orders(spark, sf_dir).select("o_orderkey", "label")
    return split.stratified_holdout(rows, "label", "o_orderkey", rows_per_bucket=100)


@query(f"with {_O} select o_orderkey, cast({_H} % 5 as int) fold from o")
def kfold(spark, sf_dir):
    return split.kfold(_orders(spark, sf_dir).select("o_orderkey"), "o_orderkey")


_STRATIFIED_FOLDS = f"""with {_O}
select o_orderkey, label, cast((row_number() over (partition by label order by {_H}, o_orderkey) - 1) % 5 as int) fold from o"""


@query(_STRATIFIED_FOLDS)
def stratified_kfold(spark, sf_dir):
    return split.stratified_kfold(_orders(spark, sf_dir).select("o_orderkey", "label"), "label", "o_orderkey")


@query(_STRATIFIED_FOLDS)
def stratified_kfold_bucketed(spark, sf_dir):
    rows = _orders(spark, sf_dir).select("o_orderkey", "label")
    return split.stratified_kfold(rows, "label", "o_orderkey", rows_per_bucket=100)
