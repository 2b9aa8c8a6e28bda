"""Query registry and the tables that queries start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelrank.session import spread, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Columns of a table, on all cores even if it is one small file; for work that is heavy per row."""
    return spread(table(spark, sf_dir, name).select(*cols))


def player_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and year, with statistics, two categories and gaps by rule.

    Items are added up per order, and orders per customer and year, before names are joined.
    """
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    per_order = items.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d"))
    per_year = (
        orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey", F.year("o_orderdate").alias("season"))
        .agg(
            F.count(F.lit(1)).alias("gp"), F.round(F.sum("o_totalprice"), 2).alias("pts"),
            F.round(F.sum("q"), 2).alias("fga"), F.round(F.sum("d"), 4).alias("ast"),
            F.max("o_totalprice").alias("best"),
        )
    )
    return (
        per_year.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey", "season", F.col("c_name").alias("player"), F.col("n_name").alias("tm"),
            F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("pos"),
            "gp", "pts", "fga", "ast",
            F.when(F.col("c_custkey") % 7 != 0, F.col("best")).alias("award_share"),
        )
    )


def stored_player_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, stored once, for queries that read them several times."""
    return staged(player_season(spark, sf_dir), "player-season")


PLAYER_SEASON = """
ps as (
  select c_custkey, cast(year(o_orderdate) as int) season, c_name player, n_name tm,
         case when c_custkey % 11 = 0 then null else c_mktsegment end pos,
         count(*) gp, round(sum(o_totalprice), 2) pts, round(sum(q), 2) fga, round(sum(d), 4) ast,
         case when c_custkey % 7 = 0 then null else max(o_totalprice) end award_share
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  left join (select l_orderkey, sum(l_quantity) q, sum(l_discount) d from lineitem group by 1) l
    on l_orderkey = o_orderkey
  group by c_custkey, 2, c_name, n_name, c_mktsegment
)
"""

LABELLED = PLAYER_SEASON + """,
lab as (
  select *, coalesce(award_share = max(award_share) over (partition by season), false) mvp_award from ps
)
"""


def sql_hash(seed: int, key: str) -> str:
    """SQL for the 32-bit key hash."""
    return f"cast('0x' || substr(md5('{seed}:' || {key}), 1, 8) as bigint)"
