from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labelrank.operators.bayes import GaussianNaiveBayes
from labelrank.operators.forest import HistogramForest
from labelrank.operators.groups import label_winners
from labelrank.operators.neighbors import NearestNeighbors
from labelrank.operators.prep import assemble
from labelrank.operators.split import holdout, season_between
from labelrank.plans import registry, scoring, training, tuning
from labelrank.plans.preparation import prepare
from labelrank.queries.base import LABELLED, query, spread_table, sql_hash, stored_player_season
from labelrank.queries.evaluating import _report_sql, rounded_report
from labelrank.queries.preparing import ITEM_KEYS, ITEM_NUMBERS
from labelrank.session import ensure_checkpoint_dir, scratch_path
from labelrank.sources.tables import load_model, save_model

WIDTH = 64


def vectors(spark, sf_dir):
    """(row_key, label, features): embeddings, with the first three labels as the positive class."""
    ensure_checkpoint_dir(spark)  # boosting cuts its lineage there
    return spread_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(
        F.col("vec_id").alias("row_key"), (F.col("label") < 3).cast("double").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )


def _models(shape):
    return registry.models(shape, weight="weight")


def _fit_and_score(spark, sf_dir, name):
    """Scores of the hold-out rows by the named model, fitted on the other rows."""
    rows = holdout(vectors(spark, sf_dir), "row_key")
    train = rows.where("not is_test").drop("is_test")
    shape = registry.shape_of(train, WIDTH)
    train = registry.add_weight(train, shape)
    model = _models(shape)[name].fit(train)
    test = rows.where("is_test").drop("is_test")
    return scoring.score_all({name: model}, test, ["row_key", "label"])


def _train_query(query_name: str, model: str):
    def run(spark, sf_dir):
        return _fit_and_score(spark, sf_dir, model)
    query(name=query_name)(run)


for _query_name, _model in {
    "train_rf": "RandomForest", "train_gbt_a": "BoostedTreesWeighted", "train_gbt_b": "BoostedTreesDeep",
    "train_gbt_c": "BoostedTreesLeafy", "train_svm": "SVM", "train_logreg": "LogisticL1", "train_mlp": "ANN",
}.items():
    _train_query(_query_name, _model)


_SPLIT_COLUMNS = ["l_quantity", "l_discount", "l_tax"]


def _split_sql(rows: str, tag: str) -> str:
    """The cut of the lowest Gini impurity over the rows: (f, x)."""
    return f"""
v{tag} as (
  select f, x, count(*) n, sum(y) p
  from (select unnest({_SPLIT_COLUMNS}) f, unnest([{', '.join(f'{c}::double' for c in _SPLIT_COLUMNS)}]) x, y from {rows}) group by all
),
c{tag} as (
  select f, x, sum(n) over (partition by f order by x) n, sum(p) over (partition by f order by x) p,
         sum(n) over (partition by f) tn, sum(p) over (partition by f) tp from v{tag}
),
b{tag} as (
  select f, x from c{tag} where n < tn
  order by ((n - p) ** 2 + p ** 2) / n + ((tn - tp - n + p) ** 2 + (tp - p) ** 2) / (tn - n) desc, f, x limit 1
)"""


_BELOW = " ".join(["case f", *[f"when '{c}' then {c}::double" for c in _SPLIT_COLUMNS], "end"])


@query(f"""with r as (select *, cast(l_returnflag = 'R' as int) y from lineitem), {_split_sql('r', '')},
lo as (select r.* from r, b where {_BELOW} <= x), {_split_sql('lo', '_lo')},
hi as (select r.* from r, b where {_BELOW} > x), {_split_sql('hi', '_hi')}
select '' path, b.f as feature, b.x as cut, round((select avg(y) from r), 9) share from b
union all select 'L', f, x, round((select avg(y) from lo), 9) from b_lo
union all select 'R', f, x, round((select avg(y) from hi), 9) from b_hi
union all select 'LL', null, null, round(avg(y), 9) from lo, b_lo where {_BELOW} <= x
union all select 'LR', null, null, round(avg(y), 9) from lo, b_lo where {_BELOW} > x
union all select 'RL', null, null, round(avg(y), 9) from hi, b_hi where {_BELOW} <= x
union all select 'RR', null, null, round(avg(y), 9) from hi, b_hi where {_BELOW} > x""")
def forest_tree(spark, sf_dir):
    """The nodes of one tree of two levels over all items and three columns, nothing drawn; its table goes through the node queue."""
    items = spread_table(spark, sf_dir, "lineitem", *_SPLIT_COLUMNS, "l_returnflag")
    rows = assemble(items.withColumn("label", (F.col("l_returnflag") == "R").cast("double")), _SPLIT_COLUMNS)
    forest = HistogramForest(numTrees=1, maxDepth=2, subset="all", bootstrap=False, smallBytes=0)
    tree = {k: v[0] for k, v in forest.fit(rows).trees.to_pydict().items()}
    path = {0: ""}
    for node, (left, right) in enumerate(zip(tree["left"], tree["right"])):  # parents come before their children
        if left > 0:
            path[left], path[right] = path[node] + "L", path[node] + "R"
    nodes = [
        (path[i], _SPLIT_COLUMNS[f] if f >= 0 else None, c if f >= 0 else None, round(v, 9))
        for i, (f, c, v) in enumerate(zip(tree["feature"], tree["cut"], tree["value"]))]
    return spark.createDataFrame(nodes, "path string, feature string, cut double, share double")


_KNN = f"""with s as (select vec_id, embedding, label, {sql_hash(42, 'vec_id')} / 4294967296.0::double < 0.2 is_test from embeddings),
d as (
  select q.vec_id, t.vec_id tid, t.label,
         pow(list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda z: pow(abs(z[1]::double - z[2]::double), 3))), 1 / 3.0) dist
  from s q join s t on q.is_test and not t.is_test
),
n as (select * from (select *, row_number() over (partition by vec_id order by dist, tid) rn from d) where rn <= 3),
w as (
  select vec_id, label, case when min(dist) over (partition by vec_id) = 0 then cast(dist = 0 as double) else 1 / dist end w from n
),
v as (select vec_id, label, round(sum(w), 6) vote from w group by 1, 2)
select vec_id, cast(label as int) as label, vote from (select *, row_number() over (partition by vec_id order by vote desc, label) rn from v)
where rn = 1"""


def _knn(spark, sf_dir, **kw):
    """Every hold-out row against all the others, all ten labels."""
    rows = holdout(
        spread_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(
            F.col("vec_id").alias("row_key"), "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")),
        "row_key")
    model = NearestNeighbors(k=3, p=3.0, weights="distance", **kw).fit(rows.where("not is_test"))
    return model.elected(rows.where("is_test")).select(
        F.col("query").alias("vec_id"), F.col("prediction").cast("int").alias("label"), "vote")


@query(_KNN)
def knn_vote(spark, sf_dir):
    return _knn(spark, sf_dir)


@query(_KNN)
def knn_vote_cells(spark, sf_dir):
    """Nothing broadcast: the search goes through cells and blocks as it would on a large table."""
    return _knn(spark, sf_dir, broadcastRows=0, blockRows=200, pivots=16)


_LL = " + ".join(
    f"-0.5 * ln(2 * pi() * ({c}_v + eps)) - ({c} - {c}_m) * ({c} - {c}_m) / (2 * ({c}_v + eps))" for c in ITEM_NUMBERS)


@query(f"""with e as (select 9.748288799431293e-07 * greatest({', '.join(f'var_pop({c})' for c in ITEM_NUMBERS)}) eps from lineitem),
g as (
  select l_returnflag flag, ln(count(*) / sum(count(*)) over ()) prior,
         {', '.join(f'avg({c}) {c}_m, var_pop({c}) {c}_v' for c in ITEM_NUMBERS)} from lineitem group by 1
),
u as (select row_number() over () rid, l_orderkey, l_linenumber, {', '.join(ITEM_NUMBERS)} from lineitem),
l as (select rid, u.l_orderkey, u.l_linenumber, {', '.join('u.' + c for c in ITEM_NUMBERS)}, flag, prior + {_LL} ll from u, g, e)
select l_orderkey, l_linenumber, {', '.join(ITEM_NUMBERS)},
       cast(case arg_max(flag, ll) when 'A' then 0 when 'N' then 1 else 2 end as int) prediction,
       round(exp(max(case when flag = 'R' then ll end) - max(ll)) / sum(exp(ll - m)), 6) score
from (select *, max(ll) over (partition by rid) m from l)
group by rid, l_orderkey, l_linenumber, {', '.join(ITEM_NUMBERS)}""")
def gaussian_nb(spark, sf_dir):
    """Three classes of items, fitted on and applied to every row of the table."""
    flag = F.col("l_returnflag")
    rows = spread_table(spark, sf_dir, "lineitem", *ITEM_KEYS, *ITEM_NUMBERS, "l_returnflag").select(
        *ITEM_KEYS, *ITEM_NUMBERS, F.when(flag == "A", 0.0).when(flag == "N", 1.0).otherwise(2.0).alias("label"))
    rows = assemble(rows, ITEM_NUMBERS)
    model = GaussianNaiveBayes().fit(rows)
    return model.transform(rows).select(
        *ITEM_KEYS, *ITEM_NUMBERS, F.col("prediction").cast("int").alias("prediction"), F.round("score", 6).alias("score"))


@query()
def score_all(spark, sf_dir):
    """Every registered model fitted on the training part; every test row scored by every model."""
    rows = holdout(vectors(spark, sf_dir), "row_key")
    train, test = rows.where("not is_test").drop("is_test"), rows.where("is_test").drop("is_test")
    shape = registry.shape_of(train, WIDTH)
    train, models = registry.add_weight(train, shape), _models(shape)
    return scoring.score_all(training.fit_all(models, train, 8), test, ["row_key", "label"])


@query()
def rank_with_models(spark, sf_dir):
    """From raw statistics to ranked lists: prepare, fit on earlier seasons, rank the later ones."""
    done = prepare(stored_player_season(spark, sf_dir), ids=["c_custkey"], fit_on=F.col("season") < 2000)
    rows = assemble(done.table, done.features).select(
        F.col("c_custkey").alias("row_key"), "season", "player", F.col("mvp_award").alias("label"), "features")
    train = rows.where(F.col("season").between(1995, 1999))
    shape = registry.shape_of(train, len(done.features))
    train = registry.add_weight(train, shape)
    ensure_checkpoint_dir(spark)
    models = training.fit_all(_models(shape), train, 8)
    return scoring.rank_seasons(models, rows, [2000, 2001])


def dense_net():
    """A small fixed network: halves of the vector are averaged, rectified and joined by a logistic unit."""
    import numpy as np

    hidden = np.zeros((WIDTH, 2), dtype=np.float32)
    hidden[: WIDTH // 2, 0] = hidden[WIDTH // 2 :, 1] = 2.0 / WIDTH
    out = np.array([3.0, -2.0], dtype=np.float32)

    def predict(x):
        return 1.0 / (1.0 + np.exp(-(np.maximum(x.reshape(len(x), WIDTH) @ hidden, 0.0) @ out + 0.5)))

    return predict


_NET = """select vec_id, round(1 / (1 + exp(-(3 * greatest(list_avg(embedding[1:32]), 0)
       - 2 * greatest(list_avg(embedding[33:64]), 0) + 0.5))), 4) score from embeddings"""


@query(_NET)
def score_external(spark, sf_dir):
    rows = spread_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return scoring.score_external(rows, dense_net, WIDTH, "embedding").select("vec_id", F.round("score", 4).alias("score"))


@query(_NET)
def score_external_tensor(spark, sf_dir):
    """The same network fed with rows of shape (width, 1)."""
    rows = spread_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    scored = scoring.score_external(rows, dense_net, WIDTH, "embedding", unit_axis=True)
    return scored.select("vec_id", F.round("score", 4).alias("score"))


def _roundtrip(spark, sf_dir, names):
    rows = vectors(spark, sf_dir)
    shape = registry.shape_of(rows, WIDTH)
    rows, estimators = registry.add_weight(rows, shape), _models(shape)
    base = scratch_path(spark, "saved")
    fitted = {n: PipelineModel([m]) for n, m in training.fit_all(_some(estimators, *names), rows, 8).items()}
    for name, model in fitted.items():
        save_model(model, base, name)
    before = scoring.score_all(fitted, rows, ["row_key"]).withColumnRenamed("score", "old")
    after = scoring.score_all({n: load_model(base, n) for n in fitted}, rows, ["row_key"])
    return before.join(after, ["row_key", "model"]).select(
        "row_key", "model", (F.abs(F.col("old") - F.col("score")) < 1e-9).alias("same"))


@query("""select vec_id as row_key, model, true as same from embeddings
cross join (values ('RandomForest'), ('BoostedTreesDeep'), ('KNN'), ('SVM'), ('LogisticL1'), ('GaussianNB'), ('ANN')) m(model)""")
def model_roundtrip(spark, sf_dir):
    """Models saved and loaded again give every row the same score."""
    return _roundtrip(spark, sf_dir, ("RandomForest", "KNN", "SVM", "LogisticL1", "GaussianNB", "ANN", "BoostedTreesDeep"))


@query("""select vec_id as row_key, model, true as same from embeddings
cross join (values ('BoostedTreesWeighted'), ('BoostedTreesLeafy')) m(model)""")
def model_roundtrip_boosted(spark, sf_dir):
    """The same for the other two boosted models."""
    return _roundtrip(spark, sf_dir, ("BoostedTreesWeighted", "BoostedTreesLeafy"))


def _some(searches: dict, *names: str) -> dict:
    return {n: searches[n] for n in names}


@query()
def stacking(spark, sf_dir):
    rows = holdout(vectors(spark, sf_dir), "row_key")
    train, test = rows.where("not is_test").drop("is_test"), rows.where("is_test").drop("is_test")
    model = registry.stacking(registry.shape_of(train, WIDTH)).fit(train)
    return scoring.score_all({"Stacking": model}, test, ["row_key", "label"])


@query()
def compare_holdout(spark, sf_dir):
    """All models on one stratified hold-out, best accuracy first."""
    rows = vectors(spark, sf_dir)
    shape = registry.shape_of(rows, WIDTH)
    found = training.compare(registry.add_weight(rows, shape), _models(shape), stratify=True, parallelism=8)
    return found.leaderboard()


def _compare_cv(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    shape = registry.shape_of(rows, WIDTH)
    return training.compare(registry.add_weight(rows, shape), _models(shape), cross_validate=True, parallelism=8)


@query()
def compare_cv(spark, sf_dir):
    """Class reports of all models on five folds."""
    return _compare_cv(spark, sf_dir).reports


@query()
def timings(spark, sf_dir):
    """Mean accuracy, fit time and prediction time of the same models over five folds, eight fits at a time."""
    return _compare_cv(spark, sf_dir).mean_times()


def _searches(rows):
    return registry.tuned_models(registry.shape_of(rows, WIDTH))


@query()
def grid_search(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    found = tuning.grid_search(rows, _searches(rows), parallelism=8)
    return found.select("model", "candidate", F.to_json("params").alias("params"), "mean_accuracy")


@query()
def refit_best(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    searches = _searches(rows)
    found = tuning.grid_search(rows, searches, parallelism=8)
    return tuning.refit_best(rows, found, searches, parallelism=8).metrics.select("model", "fold", "accuracy", "mae")


# --- the same flows with models that SQL can express, so that every number can be checked ------------

_VECTORS = f"""
e as (
  select vec_id, cast(label < 3 as int) y, cast({sql_hash(42, 'vec_id')} % 5 as int) fold, embedding::double[] embedding
  from embeddings
)"""

_BAYES_CV = f"""{_VECTORS},
x as (select vec_id, y, fold, unnest(embedding) v, generate_subscripts(embedding, 1) dim from e),
parts as (select unnest(range(5)) part),
st as (select part, y cls, dim, avg(v) m, var_pop(v) s from x join parts on fold <> part group by all),
ep as (
  select part, 9.748288799431293e-07 * max(s) eps
  from (select part, dim, var_pop(v) s from x join parts on fold <> part group by all) group by 1
),
pr as (
  select part, y cls, ln(count(*) / sum(count(*)) over (partition by part)) prior
  from e join parts on fold <> part group by 1, 2
),
ll as (
  select vec_id, x.y, x.fold, st.cls, any_value(prior) + sum(-0.5 * ln(2 * pi() * (s + eps)) - (v - m) ** 2 / (2 * (s + eps))) ll
  from x join st on x.fold = st.part and x.dim = st.dim join ep on ep.part = x.fold
  join pr on pr.part = x.fold and pr.cls = st.cls group by 1, 2, 3, 4
),
p as (select 'GaussianNB' model, fold, y as label, arg_max(cls, ll) prediction from ll group by vec_id, fold, y)"""


def _bayes_cv(spark, sf_dir):
    return training.compare(vectors(spark, sf_dir), {"GaussianNB": GaussianNaiveBayes()}, cross_validate=True)


@query(f"""with {_BAYES_CV}
select model, fold, round(avg(cast(label = prediction as int)), 6) accuracy, round(avg(abs(label - prediction)), 6) mae,
       true as cross_validation from p group by 1, 2""")
def cv_metrics(spark, sf_dir):
    metrics = _bayes_cv(spark, sf_dir).metrics
    return metrics.select("model", "fold", F.round("accuracy", 6).alias("accuracy"), F.round("mae", 6).alias("mae"), "cross_validation")


@query(f"with {_BAYES_CV}, {_report_sql('model, fold', 1.0)}")
def cv_reports(spark, sf_dir):
    return rounded_report(_bayes_cv(spark, sf_dir).reports)


def _knn_sql(folds: str, ks: list[int], tag: str = "") -> str:
    """Prediction of every row from the rows of other folds, for each k and weighting."""
    return f"""
f{tag} as ({folds}),
d{tag} as (
  select q.vec_id, q.y, q.fold, t.vec_id tid, t.y ty, list_distance(q.embedding, t.embedding) dist
  from f{tag} q join f{tag} t on q.fold <> t.fold
),
n{tag} as (select *, row_number() over (partition by vec_id order by dist, tid) rn from d{tag} qualify rn <= {max(ks)}),
c{tag} as (
  select *, (k_at * 2 + w_at) candidate from (values {', '.join(f'({i}, {k})' for i, k in enumerate(ks))}) a(k_at, k),
  (values (0, 'uniform'), (1, 'distance')) b(w_at, weights)
),
w{tag} as (
  select candidate, k, weights, vec_id, y, fold, ty,
         case when weights = 'uniform' then 1 when min(dist) over (partition by candidate, vec_id) = 0 then cast(dist = 0 as double)
              else 1 / dist end w from n{tag} join c{tag} on rn <= k
),
v{tag} as (select candidate, k, weights, vec_id, y, fold, ty, round(sum(w), 6) vote from w{tag} group by all),
pred{tag} as (select candidate, k, weights, vec_id, y, fold, arg_min(ty, (-vote, ty)) yhat from v{tag} group by all)"""


_STRATIFIED_FOLDS = f"""select vec_id, y, embedding,
  (row_number() over (partition by y order by {sql_hash(42, 'vec_id')}, vec_id) - 1) % 5 fold from e"""

_GRID = f"""{_VECTORS}, {_knn_sql(_STRATIFIED_FOLDS, [3, 5, 7])},
grid as (
  select candidate, k, weights, round(avg(acc), 6) mean_accuracy
  from (select candidate, k, weights, fold, avg(cast(y = yhat as int)) acc from pred group by all) group by 1, 2, 3
)"""


def _knn_search(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    searches = _some(registry.tuned_models(registry.shape_of(rows, WIDTH)), "KNN")
    return rows, searches, tuning.grid_search(rows, searches)


def _settings(col="params"):
    return F.concat(F.lit("k="), F.col(col)["k"], F.lit(", weights="), F.col(col)["weights"]).alias("params")


@query(f"""with {_GRID}
select 'KNN' model, cast(candidate as int) candidate, 'k=' || k || ', weights=' || weights params, mean_accuracy from grid""")
def grid_search_knn(spark, sf_dir):
    """All six settings, by stratified five-fold accuracy."""
    found = _knn_search(spark, sf_dir)[2]
    return found.select("model", "candidate", _settings(), F.round("mean_accuracy", 6).alias("mean_accuracy"))


@query(f"""with {_GRID},
best as (select k, weights from grid order by mean_accuracy desc, candidate limit 1),
{_knn_sql('select * from e', [3, 5, 7], '_plain')}
select 'KNN' model, fold, round(avg(cast(y = yhat as int)), 6) accuracy
from pred_plain join best using (k, weights) group by fold""")
def refit_best_knn(spark, sf_dir):
    """The best setting, cross-validated again on plain shuffled folds."""
    rows, searches, found = _knn_search(spark, sf_dir)
    metrics = tuning.refit_best(rows, found, searches, parallelism=8).metrics
    return metrics.select("model", "fold", F.round("accuracy", 6).alias("accuracy"))


def _held_out_scores(spark, sf_dir, names):
    rows = holdout(vectors(spark, sf_dir), "row_key")
    train, test = rows.where("not is_test").drop("is_test"), rows.where("is_test").drop("is_test")
    shape = registry.shape_of(train, WIDTH)
    train, models = registry.add_weight(train, shape), _models(shape)
    return scoring.score_all(training.fit_all(_some(models, *names), train, 8), test, ["row_key", "label"])


@query(f"""with h as (select vec_id, cast(label < 3 as double) as label, {sql_hash(42, 'vec_id')} / 4294967296.0::double < 0.2 is_test from embeddings)
select vec_id as row_key, label, model, true as valid from h
cross join (values ('RandomForest'), ('BoostedTreesDeep'), ('LogisticL1'), ('ANN'), ('GaussianNB'), ('KNN')) m(model) where is_test""")
def scores_valid(spark, sf_dir):
    """Every hold-out row has one score per model, within [0, 1], and a class of 0 or 1."""
    names = ("RandomForest", "BoostedTreesDeep", "LogisticL1", "ANN", "GaussianNB", "KNN")
    scored = _held_out_scores(spark, sf_dir, names)
    valid = F.col("score").between(0, 1) & F.col("prediction").isin(0, 1)
    return scored.select("row_key", "label", "model", valid.alias("valid"))


@query(f"""with h as (select vec_id, cast(label < 3 as double) as label, {sql_hash(42, 'vec_id')} / 4294967296.0::double < 0.2 is_test from embeddings)
select vec_id as row_key, label, model, true as valid from h
cross join (values ('BoostedTreesWeighted'), ('BoostedTreesLeafy'), ('SVM')) m(model) where is_test""")
def scores_valid_others(spark, sf_dir):
    """The same for the other boosted models; the margin of the SVM has no bounds, its sign is the class."""
    scored = _held_out_scores(spark, sf_dir, ("BoostedTreesWeighted", "BoostedTreesLeafy", "SVM"))
    score, cls = F.col("score"), F.col("prediction")
    margin = (F.abs(score) < float("inf")) & ((score > 0).cast("int") == cls)
    valid = F.when(F.col("model") == "SVM", margin).otherwise(score.between(0, 1) & cls.isin(0, 1))
    return scored.select("row_key", "label", "model", valid.alias("valid"))


_POINTS_GAMES = ["gp", "pts"]
_JOINT = " + ".join(
    f"-0.5 * ln(2 * pi() * ({c}_v + eps)) - ({c} - {c}_m) * ({c} - {c}_m) / (2 * ({c}_v + eps))" for c in _POINTS_GAMES)


@query(f"""with {LABELLED},
tr as (select * from lab where season between 1995 and 1999),
ep as (select 9.748288799431293e-07 * greatest({', '.join(f'var_pop({c})' for c in _POINTS_GAMES)}) eps from tr),
g as (
  select cast(mvp_award as int) cls, ln(count(*) / sum(count(*)) over ()) prior,
         {', '.join(f'avg({c}) {c}_m, var_pop({c}) {c}_v' for c in _POINTS_GAMES)} from tr group by 1
),
ll as (select lab.season, player, c_custkey, cls, prior + {_JOINT} ll from lab, g, ep where season in (2000, 2001)),
sc as (
  select season, player, c_custkey, exp(max(case when cls = 1 then ll end) - max(ll)) / sum(exp(ll - m)) score
  from (select *, max(ll) over (partition by season, c_custkey) m from ll) group by 1, 2, 3
),
top as (select *, row_number() over (partition by season order by score desc, player, c_custkey) rnk from sc qualify rnk <= 10),
first as (select season, min_by(player, c_custkey) winner from lab where mvp_award group by 1)
select t.season, any_value(winner) mvp, 'GaussianNB' model, string_agg(player, ', ' order by rnk) top_k,
       coalesce(bool_or(player = winner), false) mvp_in_top_k
from top t left join first f on t.season = f.season group by t.season""")
def rank_with_bayes(spark, sf_dir):
    """From labelled statistics to ranked lists: fit on the earlier seasons, rank the later ones."""
    labelled = label_winners(stored_player_season(spark, sf_dir))
    rows = assemble(labelled, _POINTS_GAMES).select(
        F.col("c_custkey").alias("row_key"), "season", "player", F.col("mvp_award").cast("double").alias("label"), "features")
    model = GaussianNaiveBayes().fit(season_between(rows, 1995, 1999))
    return scoring.rank_seasons({"GaussianNB": model}, rows, [2000, 2001])
