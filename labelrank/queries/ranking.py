from __future__ import annotations

from pyspark.sql import functions as F

from labelrank.operators import groups, rank
from labelrank.queries.base import LABELLED, player_season, query, stored_player_season

# Score columns that stand in for models.
SCORES = {"by_points": "pts", "by_games": "gp", "by_assists": "ast"}

_LONG = LABELLED + """,
sc as (
  select season, player, c_custkey row_key, 'by_points' model, cast(pts as double) score from lab
  union all select season, player, c_custkey, 'by_games', cast(gp as double) from lab
  union all select season, player, c_custkey, 'by_assists', cast(ast as double) from lab
),
top as (
  select * from (
    select *, row_number() over (partition by season, model order by score desc nulls last, player, row_key) rnk
    from sc) where rnk <= 10
),
first as (
  select season, min_by(player, c_custkey) winner, min(c_custkey) winner_key from lab where mvp_award group by 1
)
"""


def labelled(spark, sf_dir):
    return groups.label_winners(stored_player_season(spark, sf_dir))


def scores(lab):
    return rank.long_scores(lab.withColumnRenamed("c_custkey", "row_key"), SCORES, ["season", "player", "row_key"])


def winners(lab):
    return lab.where("mvp_award").select("season", "player", F.col("c_custkey").alias("row_key"))


@query(f"with {LABELLED} select c_custkey, season, player, award_share, mvp_award from lab")
def label_winner(spark, sf_dir):
    return labelled(spark, sf_dir).select("c_custkey", "season", "player", "award_share", "mvp_award")


@query(f"with {LABELLED} select season, max(award_share) best from ps group by 1")
def season_best(spark, sf_dir):
    return groups.group_max(player_season(spark, sf_dir), "season", "award_share", "best")


@query(f"with {LABELLED} select season, cast(sum(mvp_award::int) as bigint) winners from lab group by 1 order by 1")
def winners_per_season(spark, sf_dir):
    return groups.flag_totals(labelled(spark, sf_dir), "season", "mvp_award")


@query(f"with {_LONG} select season, winner, winner_key from first")
def first_winner(spark, sf_dir):
    return groups.first_winner(labelled(spark, sf_dir), "season", "mvp_award", "player", "c_custkey")


@query(f"with {_LONG} select season, model, player, row_key, score, cast(rnk as int) rank from top")
def season_topk(spark, sf_dir):
    return rank.top_k(scores(player_season(spark, sf_dir))).select(
        "season", "model", "player", "row_key", "score", "rank")


TOPK_HITS = f"""with {_LONG}
select t.season, any_value(winner) mvp, model, string_agg(player, ', ' order by rnk) top_k,
       coalesce(bool_or(player = winner), false) mvp_in_top_k
from top t left join first f on t.season = f.season group by t.season, model"""


@query(TOPK_HITS)
def season_topk_hits(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    return rank.ranked_lists(scores(lab), winners(lab))


@query(f"""with {_LONG}
select t.season, any_value(winner) mvp, model, string_agg(player, ', ' order by rnk) top_k,
       bool_or(exists (select 1 from lab l where l.mvp_award and l.season = t.season and l.c_custkey = t.row_key)) mvp_in_top_k
from top t left join first f on t.season = f.season group by t.season, model""")
def season_topk_any_winner(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    return rank.ranked_lists(scores(lab), winners(lab), match="key", which="any")


_FLAGGED = LABELLED + """,
flagged as (
  select *, cast(row_number() over (order by pts desc nulls last, id) <= 4 as int) flag
  from (select *, c_custkey || ':' || season id from lab)
)
"""


def _flagged(spark, sf_dir):
    lab = labelled(spark, sf_dir).withColumn("id", F.concat_ws(":", "c_custkey", "season"))
    return rank.flag_top(lab, 4, "pts", "id")


@query(f"with {_FLAGGED} select id, pts, flag from flagged")
def global_top4_flag(spark, sf_dir):
    return _flagged(spark, sf_dir).select("id", "pts", "flag")


@query(f"""with {_FLAGGED}
select 'real' kind, season, player from flagged where mvp_award
union all select 'predicted', season, player from flagged where flag = 1""")
def real_vs_predicted(spark, sf_dir):
    return rank.real_and_predicted(_flagged(spark, sf_dir), "mvp_award", "flag", ["season", "player"])
