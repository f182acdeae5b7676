"""Model queries. Those of iterative models have no SQL twin; their metrics are checked in the tests."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from plumbline.catalog.registry import query, sql_hash32, table
from plumbline.functions.hashing import fold
from plumbline.operators import features, models, neighbours, ridge
from plumbline.operators.features import ColumnSpec
from plumbline.profile.univariate import union_all


def labelled_documents(spark, sf):
    """Document quality from its size, language and source."""
    text = F.col("text")
    documents = table(spark, sf, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("chars"),
        F.size(F.split(text, r"\s+")).cast("double").alias("words"),
        F.size(F.split(text, "\n")).cast("double").alias("lines"),
        (F.length(F.regexp_replace(text, r"[^#%*\d]", "")) / (F.length(text) + 1)).alias("junk"),
        "lang",
        "source",
    )
    return documents.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


SPECS = (
    ColumnSpec("chars", scaling="robust"),
    ColumnSpec("words", scaling="standard"),
    ColumnSpec("lines", scaling="standard"),
    ColumnSpec("junk", scaling="standard"),
    ColumnSpec("lang", encoding="onehot"),
    ColumnSpec("source", encoding="target"),
)


@query("model_cv_logreg")
def model_cv_logreg(spark, sf):
    scored = models.cross_validate(labelled_documents(spark, sf), "quality", "doc_id", SPECS, ["logreg"], True)
    return models.evaluate(scored, "binary")


ORDERS = f"""o as (
  select o_orderkey, o_totalprice as y, o_custkey::double as a, date_diff('day', date '1992-01-01', o_orderdate::date)::double as b,
    {sql_hash32("o_orderkey", "fold")} % 5 as f
  from orders
)"""


@query(
    "model_cv_linreg",
    f"""with {ORDERS},
t as (
  select h.f as held, count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, stddev_pop(a) as sa, stddev_pop(b) as sb,
    corr(a, b) as r, covar_pop(a, y) / stddev_pop(a) as ca, covar_pop(b, y) / stddev_pop(b) as cb
  from o join (select distinct f from o) h on o.f <> h.f group by 1
),
w as (
  select *, n * ((n + 1) * ca - n * r * cb) / ((n + 1) * (n + 1) - n * r * n * r) as wa,
    n * ((n + 1) * cb - n * r * ca) / ((n + 1) * (n + 1) - n * r * n * r) as wb
  from t
),
p as (
  select held, case when o.f = held then 'validation' else 'train' end as split, y,
    my + wa * (a - ma) / sa + wb * (b - mb) / sb as p
  from o cross join w
),
m as (
  select held, split, avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse,
    1 - avg((y - p) * (y - p)) / var_pop(y) as r2
  from p group by 1, 2
),
l as (unpivot m on mae, rmse, r2 into name metric value v),
s as (
  select metric, avg(v) filter (split = 'train') as t, avg(v) filter (split = 'validation') as v,
    stddev_pop(v) filter (split = 'validation') as d, count(v) filter (split = 'validation') as k
  from l group by 1
)
select 'linreg' as model_id, metric, round(t, 6) as train_score_mean, round(v, 6) as val_score_mean, round(d, 6) as val_score_std,
  k as usable_folds, round(t - v, 6) as train_val_gap, t - v > 0.1 as overfitting_flag,
  case when metric = 'r2' then t - v else v - t end > 0.1 as overfitting_directed
from s""",
)
def model_cv_linreg(spark, sf):
    """Order totals from customer and day, ridge of all folds from one pass."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.col("o_custkey").cast("double").alias("customer"),
        F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("day"),
        fold(F.col("o_orderkey"), 5, "fold").alias("fold"),
    )
    names = ["customer", "day"]
    fitted = ridge.ridge_by_fold(orders, names, "o_totalprice", "fold", models.PENALTY)
    summary = models.evaluate(ridge.score(orders, fitted, names, "o_totalprice", "o_orderkey", "fold"), "regression")
    rounded = ("train_score_mean", "val_score_mean", "val_score_std", "train_val_gap")
    return summary.withColumns({c: F.round(c, 6) for c in rounded})


@query(
    "model_knn",
    f"""with p as (
  select p_partkey, p_type, p_size::double as a, p_retailprice as b, {sql_hash32("p_partkey", "fold")} % 5 as f from part
),
t as (
  select h.f as held, min(a) as la, max(a) - min(a) as wa, min(b) as lb, max(b) - min(b) as wb
  from p join (select distinct f from p) h on p.f <> h.f group by 1
),
x as (
  select p_partkey, p_type, held, f, (a - la) / wa as a, (b - lb) / wb as b from p cross join t
),
d as (
  select q.p_partkey, q.held, n.p_type, (q.a - n.a) * (q.a - n.a) + (q.b - n.b) * (q.b - n.b) as d2,
    row_number() over (partition by q.p_partkey order by (q.a - n.a) * (q.a - n.a) + (q.b - n.b) * (q.b - n.b), n.p_partkey) as place
  from x q join x n on q.held = n.held and q.f = q.held and n.f <> n.held
),
v as (
  select p_partkey, held, p_type, count(*) as votes from d where place <= 15 group by 1, 2, 3
)
select v.p_partkey, held::int as fold, arg_min(p_type, (-votes, p_type)) as prediction, max(votes)::int as votes,
  round(sqrt(max(far)), 9) as farthest
from v join (select p_partkey, max(d2) as far from d where place <= 15 group by 1) e on v.p_partkey = e.p_partkey
group by 1, 2""",
)
def model_knn(spark, sf):
    """The kind of a part by its 15 nearest neighbours in size and price, each fold by the rows of the others."""
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"),
        "p_type",
        F.col("p_size").cast("double").alias("a"),
        F.col("p_retailprice").alias("b"),
        fold(F.col("p_partkey"), 5, "fold").alias("fold"),
    )
    # p_type is a handful of words; codes are their ranks.
    codes = features.label_codes(parts, "p_type")
    coded = features.with_codes(parts, F.col("p_type"), codes, "y").withColumn("y", F.col("y").cast("double"))
    coded = neighbours.stored(coded, "coded")

    def one_fold(held_out):
        train, valid = coded.where(F.col("fold") != held_out), coded.where(F.col("fold") == held_out)
        ends = train.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
        point = F.array((F.col("a") - ends[0]) / (ends[1] - ends[0]), (F.col("b") - ends[2]) / (ends[3] - ends[2])).alias("point")
        near = neighbours.stored(neighbours.nearest(train.select("key", point, "y"), valid.select("key", point)), "neighbours")
        far = near.select("key", F.sqrt(F.element_at("neighbours", -1)["d2"]).alias("far"), F.size("neighbours").alias("k"))
        return neighbours.votes(near).join(far, "key").withColumn("fold", F.lit(held_out))

    with ThreadPoolExecutor(max_workers=5) as pool:
        told = union_all(list(pool.map(one_fold, range(5))))
    named = told.join(codes.select(F.col("p_type").alias("name"), F.col("code").cast("double").alias("prediction")), "prediction")
    return named.select(
        F.col("key").alias("p_partkey"),
        "fold",
        F.col("name").alias("prediction"),
        F.round(F.col("share") * F.col("k")).cast("int").alias("votes"),
        F.round("far", 9).alias("farthest"),
    )


@query("model_cv_trees")
def model_cv_trees(spark, sf):
    """Forest, boosted trees and nearest neighbours on document quality, few trees; the tests check the metrics."""
    specs = [s for s in SPECS if s.encoding != "target"]
    scored = models.cross_validate(labelled_documents(spark, sf), "quality", "doc_id", specs, ["rf", "gbt", "knn"], True, k=2, trees=3)
    return models.evaluate(scored, "binary")
