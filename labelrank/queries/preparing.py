from __future__ import annotations

from pyspark.sql import functions as F

from labelrank.functions import above, integer_label, to_float32
from labelrank.operators import prep, profile, stats
from labelrank.plans.preparation import prepare, prepare_test
from labelrank.queries.base import (
    LABELLED, PLAYER_SEASON, player_season, query, spread_table, stored_player_season, table,
)
from labelrank.session import staged

ITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ITEM_KEYS = ["l_orderkey", "l_linenumber"]


def _rounded(df, cols, digits=6):
    return df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _each(cols, form: str, sep: str = ", ") -> str:
    return sep.join(form.format(c=c) for c in cols)


def _mode(col: str, source: str) -> str:
    return f"(select {col} from {source} where {col} is not null group by 1 order by count(*) desc, 1 limit 1)"


@query(f"""with {PLAYER_SEASON}
select c_custkey, season, coalesce(pos, {_mode('pos', 'ps')}) pos,
       {_each(['fga', 'ast', 'award_share'], 'round(coalesce({c}, (select avg({c}) from ps)), 4) {c}')}
from ps""")
def impute_mean_mode(spark, sf_dir):
    numbers = ["fga", "ast", "award_share"]
    df = staged(player_season(spark, sf_dir).select("c_custkey", "season", "pos", *numbers))
    return _rounded(prep.fit_fill(df, numbers, ["pos"]).apply(df), numbers, 4)


@query(f"""with {PLAYER_SEASON}
select 'fga' "column", round(avg(fga), 4) mean, null::varchar mode from ps
union all select 'ast', round(avg(ast), 4), null from ps
union all select 'pos', null, {_mode('pos', 'ps')}
union all select 'tm', null, {_mode('tm', 'ps')}""")
def column_statistics(spark, sf_dir):
    df = stored_player_season(spark, sf_dir)
    means, modes = stats.column_means(df, ["fga", "ast"]), stats.column_modes(df, ["pos", "tm"])
    rows = [(c, round(v, 4), None) for c, v in means.items()] + [(c, None, v) for c, v in modes.items()]
    return spark.createDataFrame(rows, "column string, mean double, mode string")


def _codes(col: str) -> str:
    return f"cast(case when {col} is null then -1 else dense_rank() over (order by {col} nulls last) - 1 end as bigint) {col}"


@query(f"with {PLAYER_SEASON} select c_custkey, season, {_codes('tm')}, {_codes('pos')} from ps")
def category_codes(spark, sf_dir):
    df = staged(player_season(spark, sf_dir).select("c_custkey", "season", "tm", "pos"))
    return prep.fit_codes(df, ["tm", "pos"]).apply(df)


@query(f"with {PLAYER_SEASON} select c_custkey, season, {_codes('player')} from ps")
def player_codes(spark, sf_dir):
    df = staged(player_season(spark, sf_dir).select("c_custkey", "season", "player"))
    return prep.fit_codes(df, ["player"]).apply(df)


# Market segments in order; the first one has no column of its own.
_SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"""with {PLAYER_SEASON}
select c_custkey, season, {_each(_SEGMENTS, "cast(coalesce(pos = '{c}', false) as int) pos_{c}")} from ps""")
def one_hot(spark, sf_dir):
    df = staged(player_season(spark, sf_dir).select("c_custkey", "season", "pos"))
    return prep.fit_one_hot(df, ["pos"]).apply(df)


_QUARTILES = "select " + _each(
    ITEM_NUMBERS, "quantile_cont({c}, 0.25) {c}_1, quantile_cont({c}, 0.75) {c}_3") + " from lineitem"
_CAP = ("round(case when {c} < {c}_1 - 1.5 * ({c}_3 - {c}_1) then {c}_1 - 1.5 * ({c}_3 - {c}_1) "
        "when {c} > {c}_3 + 1.5 * ({c}_3 - {c}_1) then {c}_3 + 1.5 * ({c}_3 - {c}_1) else {c} end, 6) {c}")


@query(f"with q as ({_QUARTILES}) select {', '.join(ITEM_KEYS)}, {_each(ITEM_NUMBERS, _CAP)} from lineitem, q")
def iqr_cap(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*ITEM_KEYS, *ITEM_NUMBERS)
    return _rounded(prep.fit_cap(df, ITEM_NUMBERS).apply(df), ITEM_NUMBERS)


@query("with o as (select o_custkey, o_totalprice from orders) " + " union all ".join(
    f"select '{c}' \"column\", round(quantile_cont({c}, 0.25), 6) q1, round(quantile_cont({c}, 0.5), 6) q2, "
    f"round(quantile_cont({c}, 0.75), 6) q3, cast(min({c}) as double) lo, cast(max({c}) as double) hi from o"
    for c in ("o_custkey", "o_totalprice")))
def exact_quantiles(spark, sf_dir):
    """Few values are held at once, so that the search by bins does the work."""
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    found, ranges = stats.quantiles(df, df.columns, [0.25, 0.5, 0.75], max_values=1000, bins=64)
    rows = [(c, *[round(v, 6) for v in found[c]], *map(float, ranges[c])) for c in df.columns]
    return spark.createDataFrame(rows, "column string, q1 double, q2 double, q3 double, lo double, hi double")


@query("select l_orderkey, l_linenumber, " + _each(
    ITEM_NUMBERS, "round(({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()), 6) {c}") + " from lineitem")
def minmax_scale(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*ITEM_KEYS, *ITEM_NUMBERS)
    return _rounded(prep.fit_scale(df, ITEM_NUMBERS).apply(df), ITEM_NUMBERS)


@query(f"""with {LABELLED}
select c_custkey, season, cast(mvp_award as int) mvp_award, cast(coalesce(ast > 0.5, false) as int) ast from lab""")
def binarize_label(spark, sf_dir):
    from labelrank.queries.ranking import labelled

    df = labelled(spark, sf_dir).select("c_custkey", "season", above(F.col("mvp_award").cast("int")).alias("mvp_award"), "ast")
    return integer_label(df, "ast")


@query("select l_orderkey, l_linenumber, " + _each(ITEM_NUMBERS, "cast({c} as float) {c}") + " from lineitem")
def features_float32(spark, sf_dir):
    return to_float32(table(spark, sf_dir, "lineitem").select(*ITEM_KEYS, *ITEM_NUMBERS), ITEM_NUMBERS)


@query("select coalesce(d.doc_id, l.doc_id) doc_id, lang, source, n_chars, quality, toxic from documents d full join labels l on d.doc_id = l.doc_id")
def concat_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return prep.concat_columns(docs, table(spark, sf_dir, "labels"), "doc_id")


@query(f"with {PLAYER_SEASON} select c_custkey, season, fga from ps where fga >= 100 or fga is null")
def min_minutes(spark, sf_dir):
    return prep.min_minutes(player_season(spark, sf_dir).select("c_custkey", "season", "fga"), "fga", 100)


_NOISE = ["pts", "gp", "ast"]


def _noise_sql(i: int, col: str) -> str:
    word = f"cast('0x' || substr(md5('42:{i // 4}:' || c_custkey || '-' || season), {1 + 8 * (i % 4)}, 8) as bigint)"
    return f"round({col} + ({word} / 4294967296.0::double * 0.2 - 0.1), 6) {col}"


@query(f"""with {PLAYER_SEASON}
select c_custkey || '-' || season id, {', '.join(_noise_sql(i, c) for i, c in enumerate(_NOISE))} from ps""")
def augment_noise(spark, sf_dir):
    df = player_season(spark, sf_dir).select(F.concat_ws("-", "c_custkey", "season").alias("id"), *_NOISE)
    return _rounded(prep.add_noise(df, _NOISE, "id"), _NOISE)


_FEATURES = ["tm", "pos", "gp", "pts", "fga", "ast"]
_SCALED = "round(case when hi_{c} = lo_{c} then 0 else ({c} - lo_{c}) / (hi_{c} - lo_{c}) end, 6) {c}"


@query(f"""with {LABELLED},
filled as (
  select c_custkey, season, player, cast(mvp_award as int) mvp_award,
         {_each(['tm', 'pos'], 'coalesce({c}, (select {c} from lab where {c} is not null group by 1 order by count(*) desc, 1 limit 1)) {c}')},
         {_each(['gp', 'pts', 'fga', 'ast'], 'coalesce(cast({c} as double), (select avg({c}) from lab)) {c}')}
  from lab
),
coded as (
  select * replace ({_each(['tm', 'pos'], 'cast(dense_rank() over (order by {c}) - 1 as double) as {c}')}) from filled
),
quart as (select {_each(_FEATURES, 'quantile_cont({c}, 0.25) {c}_1, quantile_cont({c}, 0.75) {c}_3')} from coded),
capped as (
  select c_custkey, season, player, mvp_award,
         {_each(_FEATURES, 'least(greatest({c}, {c}_1 - 1.5 * ({c}_3 - {c}_1)), {c}_3 + 1.5 * ({c}_3 - {c}_1)) {c}')}
  from coded, quart
),
span as (select {_each([*_FEATURES, 'mvp_award'], 'min({c}) lo_{c}, max({c}) hi_{c}')} from capped)
select c_custkey, season, player, {_each([*_FEATURES, 'mvp_award'], _SCALED)} from capped, span""")
def prep_flow(spark, sf_dir):
    done = prepare(stored_player_season(spark, sf_dir), ids=["c_custkey"])
    return _rounded(done.table, [*done.features, "mvp_award"])


_TEST_COLS = [f"pos_{s}" for s in _SEGMENTS] + ["gp", "pts", "fga", "ast"]


@query(f"""with {PLAYER_SEASON},
kept as (select * from ps where fga >= 100 or fga is null),
hot as (
  select c_custkey, season, {_each(_SEGMENTS, "cast(coalesce(pos = '{c}', false) as int) pos_{c}")},
         {_each(['gp', 'pts', 'fga', 'ast'], 'coalesce(cast({c} as double), (select avg({c}) from kept)) {c}')}
  from kept
),
span as (select {_each(_TEST_COLS, 'min({c}) lo_{c}, max({c}) hi_{c}')} from hot)
select c_custkey, season, {_each(_TEST_COLS, _SCALED)} from hot, span""")
def test_prep_flow(spark, sf_dir):
    raw = stored_player_season(spark, sf_dir)
    done = prepare_test(raw, ["player", "award_share", "tm"], ["pos"], "fga", 100, ids=["c_custkey", "season"])
    return _rounded(done, _TEST_COLS)


@query()
def select_by_importance(spark, sf_dir):
    items = spread_table(spark, sf_dir, "lineitem", *ITEM_KEYS, *ITEM_NUMBERS, "l_returnflag")
    df = items.select(*ITEM_KEYS, *ITEM_NUMBERS, (F.col("l_returnflag") == "R").cast("int").alias("label"))
    found = prep.feature_importances(df, ITEM_NUMBERS, "label")
    return prep.select_by_importance(df, found, [*ITEM_KEYS, "label"])


@query()
def prep_flow_selected(spark, sf_dir):
    """The whole flow, forest included; the forest sees the training seasons only."""
    done = prepare(stored_player_season(spark, sf_dir), ids=["c_custkey"], importances_kw={}, fit_on=F.col("season") < 2000)
    return done.table


_SERIES = """
s as (
  select 'all' series, l_extendedprice x from lineitem
  union all select 'winners', l_extendedprice from lineitem where l_returnflag = 'R'
),
r as (
  select series, count(*) n, min(x) lo, max(x) hi, stddev_samp(x) sd from s group by 1
)
"""


def _prices(items):
    return items.select("l_extendedprice", (F.col("l_returnflag") == "R").alias("won"))


@query(f"""with {_SERIES},
c as (
  select s.series, least(cast(floor((x - lo) / ((hi - lo) / 30)) as int) + 1, 30) bin, count(*) n
  from s join r on s.series = r.series group by 1, 2
)
select r.series, cast(b.bin as int) bin, round(lo + (b.bin - 1) * (hi - lo) / 30, 4) lo,
       round(lo + b.bin * (hi - lo) / 30, 4) hi, coalesce(c.n, 0) n
from r cross join (select unnest(range(1, 31)) bin) b left join c on c.series = r.series and c.bin = b.bin""")
def histogram30(spark, sf_dir):
    return _rounded(profile.histogram(_prices(table(spark, sf_dir, "lineitem")), "l_extendedprice", "won"), ["lo", "hi"], 4)


@query(f"""with {_SERIES},
g as (
  select series, i, lo + i * (hi - lo) / 199 x, sd * pow(n, -0.2) bw, n, (hi - lo) / 30 width
  from r cross join (select unnest(range(0, 200)) i)
)
select g.series, cast(i as int) point, round(g.x, 4) x,
       round(sum(exp(-0.5 * pow((g.x - s.x) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 12) density,
       round(sum(exp(-0.5 * pow((g.x - s.x) / bw, 2))) / (any_value(bw) * sqrt(2 * pi())) * any_value(width), 4) scaled
from g join s on g.series = s.series group by g.series, i, g.x""")
def kde_grid(spark, sf_dir):
    items = spread_table(spark, sf_dir, "lineitem", "l_extendedprice", "l_returnflag")
    df = profile.density(_prices(items), "l_extendedprice", "won")
    return _rounded(_rounded(df, ["x", "scaled"], 4), ["density"], 12)
