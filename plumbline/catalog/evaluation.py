"""Metric queries. Scored rows are line items and orders with hash scores, per supplier or fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.profiling import rounded
from plumbline.catalog.registry import query, sql_hash32, table
from plumbline.functions.hashing import fold, hash32
from plumbline.operators import evaluation as ev


def scored(spark, sf):
    """Two models' scores for orders; ties are common, and the label is the finished state."""
    key = F.col("o_orderkey")
    y = (F.col("o_orderstatus") == "F").cast("int")
    base = table(spark, sf, "orders").select(
        y.alias("y"),
        fold(key, 5, "fold").cast("bigint").alias("fold"),
        (hash32(key, "a") % 1000 + 200 * y).alias("a"),
        (hash32(key, "b") % 50).alias("b"),
    )
    models = F.array(
        F.struct(F.lit("a").alias("model_id"), (F.col("a") / 1200.0).alias("score")),
        F.struct(F.lit("b").alias("model_id"), (F.col("b") / 50.0).alias("score")),
    )
    return base.select("y", "fold", F.inline(models)).withColumn(
        "prediction", (F.col("score") > 0.5).cast("int")
    )


SCORED = f"""(select (o_orderstatus = 'F')::int as y, {sql_hash32("o_orderkey", "fold")} % 5 as fold, m.model_id,
  case m.model_id when 'a' then ({sql_hash32("o_orderkey", "a")} % 1000 + 200 * (o_orderstatus = 'F')::int) / 1200e0
    else ({sql_hash32("o_orderkey", "b")} % 50) / 50e0 end as score from orders, (values ('a'), ('b')) m(model_id))"""


@query(
    "eval_ranking",
    f"""with g as (select model_id, fold, score, count(*) as n, sum(y) as p from {SCORED} group by 1, 2, 3),
w as (select *, sum(n) over (partition by model_id, fold order by score) as ca,
  sum(n) over (partition by model_id, fold order by score desc) as cn,
  sum(p) over (partition by model_id, fold order by score desc) as cp from g),
t as (select model_id, fold, sum(n) * 1e0 as nn, sum(p) * 1e0 as pp, sum(p * (ca - (n - 1) / 2e0)) as r,
  sum(p * 1e0 * cp / cn) as ap from w group by 1, 2)
select model_id, fold, 'roc_auc' as metric, round((r - pp * (pp + 1) / 2) / (pp * (nn - pp)), 9) as value from t
union all select model_id, fold, 'pr_auc', round(ap / pp, 9) from t""",
)
def eval_ranking(spark, sf):
    return rounded(ev.ranking_metrics(scored(spark, sf)), 9)


@query(
    "eval_binary",
    f"""with c as (select model_id, fold, count(*) filter (y = 1 and score > 0.5) * 1e0 as tp,
  count(*) filter (y = 0 and score > 0.5) as fp, count(*) filter (y = 1 and score <= 0.5) as fn, count(*) as n
  from {SCORED} group by 1, 2)
select model_id, fold, 'f1' as metric, round(2 * tp / (2 * tp + fp + fn), 9) as value from c
union all select model_id, fold, 'precision', round(tp / (tp + fp), 9) from c
union all select model_id, fold, 'recall', round(tp / (tp + fn), 9) from c
union all select model_id, fold, 'accuracy', round((n - fp - fn) / (n * 1e0), 9) from c""",
)
def eval_binary(spark, sf):
    return rounded(ev.binary_metrics(scored(spark, sf)), 9)


@query(
    "eval_multiclass",
    """with r as (select 'm' as model_id, l_suppkey % 5 as fold, l_returnflag as y,
  case when l_linenumber <= 4 then l_returnflag when l_partkey % 2 = 0 then 'A' else 'N' end as h from lineitem),
c as (select model_id, fold, x.label, count(*) filter (y = x.label) as actual, count(*) filter (h = x.label) as predicted,
  count(*) filter (y = x.label and h = x.label) as hit
  from r, (select distinct l_returnflag as label from lineitem) x group by 1, 2, 3),
s as (select *, 2e0 * hit / (actual + predicted) as f1, hit * 1e0 / actual as recall from c)
select model_id, fold, 'macro_f1' as metric, round(avg(f1), 9) as value from s group by 1, 2
union all select model_id, fold, 'balanced_accuracy', round(avg(recall), 9) from s group by 1, 2
union all select model_id, fold, 'per_class_f1:' || label, round(f1, 9) from s""",
)
def eval_multiclass(spark, sf):
    guess = F.when(F.col("l_linenumber") <= 4, F.col("l_returnflag")).when(F.col("l_partkey") % 2 == 0, "A").otherwise("N")
    rows = table(spark, sf, "lineitem").select(
        F.lit("m").alias("model_id"),
        (F.col("l_suppkey") % 5).alias("fold"),
        F.col("l_returnflag").alias("y"),
        guess.alias("prediction"),
    )
    return rounded(ev.class_metrics(rows), 9)


def regression_rows(spark, sf):
    """Price predicted from quantity, per supplier group and split."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model_id"),
        (F.col("l_partkey") % 5).alias("fold"),
        F.when(F.col("l_orderkey") % 2 == 0, "train").otherwise("validation").alias("split"),
        (F.col("l_extendedprice") / 1000.0).alias("y"),
        (F.col("l_quantity") * 1.5).alias("prediction"),
    )


REGRESSION = """with r as (select 'm' || (l_suppkey % 3) as model_id, l_partkey % 5 as fold,
  case when l_orderkey % 2 = 0 then 'train' else 'validation' end as split, l_extendedprice / 1000 as y,
  l_extendedprice / 1000 - l_quantity * 1.5e0 as e from lineitem),
s as (select model_id, fold, split, avg(abs(e)) as mae, avg(e * e) as mse, var_pop(y) as v from r group by 1, 2, 3),
m as (select model_id, fold, split, 'mae' as metric, mae as value from s
  union all select model_id, fold, split, 'rmse', sqrt(mse) from s
  union all select model_id, fold, split, 'r2', 1 - mse / v from s)"""


def regression(spark, sf):
    return ev.regression_metrics(regression_rows(spark, sf), ("model_id", "fold", "split"))


@query("eval_regression", f"{REGRESSION} select model_id, fold, split, metric, round(value, 6) as value from m")
def eval_regression(spark, sf):
    return rounded(regression(spark, sf))


SUMMARY = f"""{REGRESSION}, u as (select model_id, metric,
  avg(value) filter (split = 'train') as t, avg(value) filter (split = 'validation') as v,
  stddev_pop(value) filter (split = 'validation') as d, count(value) filter (split = 'validation') as k
  from m group by 1, 2)"""


@query(
    "eval_summary",
    f"""{SUMMARY} select model_id, metric, round(t, 6) as train_score_mean, round(v, 6) as val_score_mean,
  round(d, 6) as val_score_std, k as usable_folds, round(t - v, 6) as train_val_gap, t - v > 0.1 as overfitting_flag,
  case when metric in ('mae', 'rmse') then v - t else t - v end > 0.1 as overfitting_directed from u""",
)
def eval_summary(spark, sf):
    return rounded(ev.overfitting(ev.fold_summary(regression(spark, sf))))


@query(
    "eval_best_model",
    """with e as (select o_custkey as run_id, 'm' || (o_orderkey % 4) as model_id, min(o_orderkey % 4 + 1) as rank,
  case when o_custkey % 2 = 0 then 'rmse' else 'roc_auc' end as primary_metric,
  avg(floor(o_totalprice / 100000)) as mean from orders group by 1, 2)
select distinct run_id, first_value(model_id) over w as best_model_id,
  round(first_value(mean) over w, 6) as best_primary_metric_value from e
window w as (partition by run_id order by case when primary_metric = 'rmse' then mean else -mean end, rank, model_id)""",
)
def eval_best_model(spark, sf):
    metric = F.when(F.col("run_id") % 2 == 0, "rmse").otherwise("roc_auc")
    evaluations = (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_custkey").alias("run_id"),
            F.concat(F.lit("m"), (F.col("o_orderkey") % 4).cast("string")).alias("model_id"),
        )
        .agg(
            F.min(F.col("o_orderkey") % 4 + 1).alias("rank"),
            F.avg(F.floor(F.col("o_totalprice") / 100000)).alias("primary_metric_mean"),
        )
        .withColumn("primary_metric", metric)
    )
    return rounded(ev.best_model(evaluations, ["run_id"]))


@query(
    "eval_model_ranking",
    """with c as (select distinct o_custkey as run_id, o_orderkey % 4 as r, o_orderkey % 4 = 3 as rejected from orders)
select run_id, coalesce(string_agg('m' || r, '>' order by r) filter (not rejected), '') as ranking,
  min('m' || r) filter (rejected) as rejected from c group by 1""",
)
def eval_model_ranking(spark, sf):
    r = F.col("o_orderkey") % 4
    choices = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.concat(F.lit("m"), r.cast("string")).alias("model_id"),
        F.when(r != 3, r).alias("rank"),
        (r == 3).alias("is_rejection"),
    )
    return ev.model_ranking(choices, ["run_id"]).withColumn("ranking", F.array_join("ranking", ">"))


@query(
    "eval_folds",
    """select o_orderkey, ((row_number() over (partition by o_orderstatus order by md5(o_orderkey || '|fold'), o_orderkey)
  - 1) % 5)::int as fold from orders""",
)
def eval_folds(spark, sf):
    folded = ev.stratified_folds(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")
    return folded.select("o_orderkey", "fold")


@query(
    "eval_stratification",
    """select min(n) as smallest_class, min(n) < 5 as stratification_degraded from
  (select count(*) as n from customer group by c_nationkey)""",
)
def eval_stratification(spark, sf):
    return ev.stratification_degraded(table(spark, sf, "customer"), "c_nationkey")


@query(
    "eval_near_perfect",
    """select l_suppkey as model_id, 'binary' as task_type, round(avg((l_linenumber > 1)::int) + 0.13, 9) as mean
from lineitem group by 1 having avg((l_linenumber > 1)::int) + 0.13 >= 0.98""",
)
def eval_near_perfect(spark, sf):
    evaluations = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("model_id")).agg(
        F.lit("binary").alias("task_type"),
        (F.avg((F.col("l_linenumber") > 1).cast("double")) + 0.13).alias("mean"),
    )
    return rounded(ev.near_perfect(evaluations), 9)
