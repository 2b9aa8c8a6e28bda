from __future__ import annotations

from pyspark.sql import functions as F

from labelrank.functions import key_hash
from labelrank.operators import evaluate
from labelrank.queries.base import query, sql_hash, table

# Predictions by rule on the length of a text, one rule per stand-in model.
RULES = {"over_500": 500, "over_1000": 1000, "over_2000": 2000, "over_9999": 9999}

_PRED = f"""
p as (
  select l.doc_id, quality as label, m.model, cast(n_chars > m.lim as int) prediction,
         cast({sql_hash(42, 'l.doc_id')} % 5 as int) fold
  from labels l join documents d on l.doc_id = d.doc_id
  cross join (values {', '.join(f"('{m}', {t})" for m, t in RULES.items())}) m(model, lim)
)
"""


def predictions(spark, sf_dir):
    """(doc_id, label, model, prediction, fold), one row per labelled document and rule."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rules = F.array(
        *[F.struct(F.lit(m).alias("model"), (F.col("n_chars") > t).cast("int").alias("prediction")) for m, t in RULES.items()]
    )
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select(
        "doc_id", F.col("quality").alias("label"), F.explode(rules).alias("r"),
        F.pmod(key_hash(42, "doc_id"), F.lit(5)).cast("int").alias("fold"),
    ).select("doc_id", "label", "r.model", "r.prediction", "fold")


def _report_sql(by: str, zero: float) -> str:
    keys = [k for k in by.split(", ") if k]
    sel, grp = "".join(f"{k}, " for k in keys), ", ".join([*keys, "cls"])
    tail = f"group by {by}" if by else ""
    return f"""
cm as (select {sel}label, prediction, count(*) n from p group by all),
pc as (
  select {grp}, sum(tp)::double tp, sum(s)::double s, sum(pr)::double pr from (
    select {sel}cast(label as varchar) cls, case when label = prediction then n else 0 end tp, n s, 0 pr from cm
    union all select {sel}cast(prediction as varchar), 0, 0, n from cm) group by {grp}
),
rt as (
  select *, case when pr = 0 then {zero} else tp / pr end a, case when s = 0 then {zero} else tp / s end b,
         case when s + pr = 0 then {zero} else 2 * tp / (s + pr) end f from pc
),
rep as (
  select {sel}cls as label, a pre, b recall, f f1_score, s support from rt
  union all select {sel}'accuracy', sum(tp) / sum(s), sum(tp) / sum(s), sum(tp) / sum(s), sum(tp) / sum(s) from rt {tail}
  union all select {sel}'macro avg', avg(a), avg(b), avg(f), sum(s) from rt {tail}
  union all select {sel}'weighted avg', sum(a * s) / sum(s), sum(b * s) / sum(s), sum(f * s) / sum(s), sum(s) from rt {tail}
)
select {sel}label, round(pre, 6) as "precision", round(recall, 6) recall, round(f1_score, 6) f1_score, round(support, 6) support
from rep"""


def rounded_report(report):
    numbers = ("precision", "recall", "f1_score", "support")
    return report.select(*[F.round(c, 6).alias(c) if c in numbers else F.col(c) for c in report.columns])


@query(f"""with {_PRED}
select model, round(avg(cast(label = prediction as int)), 6) accuracy, round(avg(abs(label - prediction)), 6) mae
from p group by 1""")
def accuracy_mae(spark, sf_dir):
    found = evaluate.accuracy_mae(predictions(spark, sf_dir), by=["model"])
    return found.select("model", F.round("accuracy", 6).alias("accuracy"), F.round("mae", 6).alias("mae"))


@query(f"with {_PRED}, {_report_sql('model', 0.0)}")
def class_report(spark, sf_dir):
    return rounded_report(evaluate.class_report(predictions(spark, sf_dir), by=["model"]))


@query(f"with {_PRED}, {_report_sql('model, fold', 1.0)}")
def class_report_folds(spark, sf_dir):
    """Per fold, with a ratio that has no denominator counted as 1."""
    return rounded_report(evaluate.class_report(predictions(spark, sf_dir), by=["model", "fold"], zero_division=1.0))


def _fold_metrics(spark, sf_dir):
    """Accuracy per model and fold; the time columns are stand-ins made from the counts."""
    return predictions(spark, sf_dir).groupBy("model", "fold").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        (F.count(F.lit(1)) / 1000).alias("train_time"), (F.sum("prediction") / 1000).alias("prediction_time"),
    )


_FOLDS = _PRED + """,
fm as (
  select model, fold, avg(cast(label = prediction as int)) accuracy, count(*) / 1000 train_time,
         sum(prediction) / 1000 prediction_time from p group by 1, 2
)
"""


@query(f"""with {_FOLDS}
select model, round(avg(accuracy), 6) mean_accuracy, round(avg(train_time), 6) mean_train_time,
       round(avg(prediction_time), 6) mean_prediction_time from fm group by 1""")
def fold_means(spark, sf_dir):
    means = evaluate.fold_means(_fold_metrics(spark, sf_dir))
    return means.select("model", *[F.round(c, 6).alias(c) for c in means.columns[1:]])


@query(f"""with {_FOLDS}, a as (select model, round(avg(accuracy), 6) accuracy from fm group by 1)
select model, accuracy, cast(row_number() over (order by accuracy desc, model) as int) rank from a""")
def leaderboard(spark, sf_dir):
    means = evaluate.fold_means(_fold_metrics(spark, sf_dir), ["accuracy"])
    return evaluate.leaderboard(means.select("model", F.round("mean_accuracy", 6).alias("accuracy")))


_LIMITS = (250, 500, 1000, 2000)

_CANDIDATES = f"""
c as (
  select source as model, x.candidate, x.lim, round(avg(cast(quality = cast(n_chars > x.lim as int) as int)), 6) acc
  from labels l join documents d on l.doc_id = d.doc_id
  cross join (values {', '.join(f'({i}, {t})' for i, t in enumerate(_LIMITS))}) x(candidate, lim)
  group by 1, 2, 3
)
"""


def candidates(spark, sf_dir):
    """Per source of documents: the accuracy of each limit in a grid of limits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    grid = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(t).alias("lim")) for i, t in enumerate(_LIMITS)])
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("*", F.explode(grid).alias("g"))
    right = (F.col("quality") == (F.col("n_chars") > F.col("g.lim")).cast("int")).cast("double")
    return (
        rows.groupBy(F.col("source").alias("model"), F.col("g.candidate").alias("candidate"), F.col("g.lim").alias("lim"))
        .agg(F.round(F.avg(right), 6).alias("mean_accuracy"))
        .withColumn("params", F.create_map(F.lit("limit"), F.col("lim").cast("string")))
    )


BEST_PARAMS = f"""with {_CANDIDATES}
select model, 'limit=' || lim params, acc mean_accuracy
from (select *, row_number() over (partition by model order by acc desc, candidate) rn from c) where rn = 1"""


def flat_params(best):
    return best.select("model", F.concat(F.lit("limit="), F.col("params")["limit"]).alias("params"), "mean_accuracy")


@query(BEST_PARAMS)
def best_params(spark, sf_dir):
    return flat_params(evaluate.best_params(candidates(spark, sf_dir)))


@query("""select count(*) n, cast(sum(quality) as bigint) positives, round(count(*) / sum(quality), 6) weight from labels""")
def class_weight(spark, sf_dir):
    found = evaluate.class_weight(table(spark, sf_dir, "labels"), "quality")
    return found.withColumn("weight", F.round("weight", 6))


@query(f"with {_PRED} select doc_id, label, model, prediction, fold from p")
def append_results(spark, sf_dir):
    """Results of one rule at a time, put together by a bag union."""
    rows = predictions(spark, sf_dir)
    return evaluate.append_all([rows.where(F.col("model") == m) for m in RULES])
