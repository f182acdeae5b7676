"""Plan, transform and fold queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbline.catalog.profiling import LINES, TARGET, lines, rounded, stats_sql
from plumbline.catalog.registry import query, sql_hash32, table
from plumbline.functions.hashing import fold, hash32
from plumbline.functions.stats import adjusted_skew
from plumbline.operators import features as ft
from plumbline.plans import preprocessing as prep
from plumbline.profile import dataset as ds

PLAN_SQL = f"""with {LINES}, s as ({stats_sql()}),
t as (select *, round(100e0 * (n_rows - n) / n_rows, 2) as pct, coalesce(abs(mcorr) > 0.3, false) as informative,
  case when not num or (k <= 10 and whole) then 'categorical' else 'numeric' end as effective_type,
  row_number() over (order by ordinal) as number from s where not target),
d as (select *, case when coalesce(abs(corr) > 0.95, false) then 'leakage_suspect'
  when coalesce(abs(mcorr) > 0.7, false) then 'missingness_leakage_suspect' when k <= 1 then 'is_constant'
  when num and k / (n_rows * 1e0) < 0.5 and coalesce(cv < 0.01, false) then 'is_low_variance'
  when k / (n_rows * 1e0) > 0.95 and (whole or not num) then 'is_id_like'
  when c = 'copied' then 'is_duplicate_of_other_column'
  when pct > 40 and not informative then 'has_high_missing' end as drop_reason from t),
p as (select *, case when drop_reason is not null or n = n_rows then 'none' when informative then 'constant'
    when effective_type = 'numeric' and coalesce(abs(skew) > 1, false) then 'median'
    when effective_type = 'numeric' then 'mean' when coalesce(top, 0) > 50 then 'mode' else 'constant' end as imputation,
  case when drop_reason is not null or effective_type = 'numeric' then 'none' when k = 2 then 'ordinal'
    when k <= 15 then 'onehot' else 'target' end as encoding,
  case when drop_reason is not null or effective_type = 'categorical' then 'none'
    when zero or coalesce(outliers, 0) > 5 then 'robust' else 'standard' end as scaling from d)
select 'prep_' || lpad(number::varchar, 3, '0') as claim_id, c as column_name, effective_type,
  case when drop_reason is not null then 'drop' when imputation <> 'none' and encoding <> 'none' then 'impute_and_encode'
    when imputation <> 'none' and scaling <> 'none' then 'impute_and_scale' when imputation <> 'none' then 'impute'
    when encoding <> 'none' then 'encode' when scaling <> 'none' then 'scale' else 'passthrough' end as action,
  imputation, encoding, scaling, drop_reason from p"""


@query("plan_defaults", PLAN_SQL)
def plan_defaults(spark, sf):
    """From the raw table to the plan: profile, flags, rules."""
    flagged = ds.with_flags(ds.column_statistics(lines(spark, sf), TARGET))
    return prep.plan_defaults(flagged).select(
        "claim_id", "column_name", "effective_type", "action", "imputation", "encoding", "scaling", "drop_reason"
    )


@query(
    "plan_rules",
    """with f as (select p_partkey as k, p_size as s, p_retailprice as price,
  case when p_size % 2 = 0 then 'categorical' else 'numeric' end as effective_type, p_partkey % 30 as u from part),
d as (select *, case when s = 1 then 'leakage_suspect' when s = 2 then 'missingness_leakage_suspect'
  when s = 3 then 'is_constant' when s = 4 then 'is_low_variance' when s = 5 then 'is_id_like'
  when s between 6 and 9 and not s in (6, 7) then 'has_high_missing' end as drop_reason from f),
p as (select *, case when drop_reason is not null or s < 10 and s not in (6, 7) or s % 3 = 0 then 'none'
    when s in (6, 7) then 'constant' when effective_type = 'numeric' and s % 5 = 0 then 'median'
    when effective_type = 'numeric' then 'mean' when s > 25 then 'mode' else 'constant' end as imputation,
  case when drop_reason is not null or effective_type = 'numeric' then 'none' when u = 2 then 'ordinal'
    when u <= 15 then 'onehot' else 'target' end as encoding,
  case when drop_reason is not null or effective_type = 'categorical' then 'none' when s % 7 = 0 or s > 40 then 'robust'
    else 'standard' end as scaling from d)
select k as part, drop_reason, case when drop_reason is not null then 'drop'
    when imputation <> 'none' and encoding <> 'none' then 'impute_and_encode'
    when imputation <> 'none' and scaling <> 'none' then 'impute_and_scale' when imputation <> 'none' then 'impute'
    when encoding <> 'none' then 'encode' when scaling <> 'none' then 'scale' else 'passthrough' end as action,
  imputation, encoding, scaling from p""",
)
def plan_rules(spark, sf):
    planned = ruled(spark, sf)
    return planned.select("part", "drop_reason", "action", "imputation", "encoding", "scaling")


def ruled(spark, sf):
    """The rule chain over one flag row per part, the flags read off its size and key."""
    s = F.col("p_size")
    flagged = table(spark, sf, "part").select(
        F.col("p_partkey").alias("part"),
        F.when(s % 2 == 0, "categorical").otherwise("numeric").alias("kind"),
        F.lit(False).alias("is_numeric_but_categorical"),
        (s == 1).alias("leakage_suspect"),
        (s == 2).alias("missingness_leakage_suspect"),
        (s == 3).alias("is_constant"),
        (s == 4).alias("is_low_variance"),
        (s == 5).alias("is_id_like"),
        F.lit(False).alias("is_redundant"),
        s.between(6, 9).alias("has_high_missing"),
        s.isin(6, 7).alias("missingness_informative"),
        ((s >= 10) & (s % 3 != 0) | s.isin(7)).alias("has_missing"),
        (s % 5 == 0).alias("is_skewed"),
        F.when(s > 25, 60.0).otherwise(40.0).alias("top_category_pct"),
        (F.col("p_partkey") % 30).alias("nunique"),
        (s % 7 == 0).alias("is_zero_inflated"),
        F.when(s > 40, 6.0).otherwise(1.0).alias("iqr_outlier_pct"),
    )
    planned = flagged.withColumn("effective_type", prep.effective_type()).withColumn("drop_reason", prep.drop_reason())
    dropped = F.col("drop_reason").isNotNull()
    for name, rule in (("imputation", prep.imputation()), ("encoding", prep.encoding()), ("scaling", prep.scaling())):
        planned = planned.withColumn(name, F.when(dropped, "none").otherwise(rule))
    return planned.withColumn("action", F.when(dropped, "drop").otherwise(prep.action()))


@query(
    "plan_evidence",
    """select p_partkey as part, i::int as place, 'col:c' || p_partkey || ':' || keys[i + 1] as metric_key from (
  select p_partkey, unnest(range(len(keys))) as i, keys from (select p_partkey, ['dtype', 'nunique'] || case p_size
    when 1 then ['leakage_suspect'] when 2 then ['missingness_leakage_suspect', 'missingness_target_corr']
    when 3 then ['is_constant'] when 4 then ['is_low_variance'] when 5 then ['is_id_like']
    when 8 then ['has_high_missing', 'missingness_informative'] when 9 then ['has_high_missing', 'missingness_informative']
    else ['missing_pct', 'has_missing', 'missingness_informative', 'is_skewed', 'top_category_pct', 'iqr_outlier_pct',
      'is_zero_inflated', 'nonzero_pct', 'is_numeric_but_categorical'] end as keys from part))""",
)
def plan_evidence(spark, sf):
    """The metrics that each plan row cites, in order."""
    planned = ruled(spark, sf).withColumn("column_name", F.concat(F.lit("c"), F.col("part").cast("string")))
    return planned.select("part", F.posexplode(prep.evidence_keys()).alias("place", "metric_key"))


OVERRIDE_SQL = """with p as (select o_custkey as run_id, o_orderkey as c, case when o_orderstatus = 'P' then 'drop' else 'scale' end
  as action, case when o_orderstatus = 'P' then 'none' else 'standard' end as scaling, o_orderkey % 3 = 0 as proposed,
  case when o_orderkey % 6 = 0 then 'robust' else 'standard' end as new_scaling from orders),
q as (select *, proposed and new_scaling <> scaling as differs from p),
r as (select *, case when differs and action <> 'drop' then
  row_number() over (partition by run_id, differs and action <> 'drop' order by c) end as rn from q)
select run_id, 'c' || c as column_name, action, case when rn <= 3 then new_scaling else scaling end as scaling,
  coalesce(rn <= 3, false) as is_override, case when rn <= 3 then 'because' else '' end as override_reason,
  case when differs and action = 'drop' then 'DROP_OVERRIDE_REJECTED:c' || c
    when rn > 3 then 'OVERRIDE_CAP_REACHED:c' || c end as log from r"""


def overridden(spark, sf):
    orders = table(spark, sf, "orders")
    name = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    drop = F.col("o_orderstatus") == "P"
    plans = orders.select(
        F.col("o_custkey").alias("run_id"),
        name.alias("column_name"),
        F.col("o_orderkey").alias("ordinal"),
        F.when(drop, "drop").otherwise("scale").alias("action"),
        F.lit("none").alias("imputation"),
        F.lit("none").alias("encoding"),
        F.when(drop, "none").otherwise("standard").alias("scaling"),
    )
    proposals = orders.where("o_orderkey % 3 = 0").select(
        F.col("o_custkey").alias("run_id"),
        name.alias("column_name"),
        F.lit("none").alias("imputation"),
        F.lit("none").alias("encoding"),
        F.when(F.col("o_orderkey") % 6 == 0, "robust").otherwise("standard").alias("scaling"),
        F.lit("because").alias("override_reason"),
    )
    return prep.apply_overrides(plans, proposals)


@query("plan_override", OVERRIDE_SQL)
def plan_override(spark, sf):
    return overridden(spark, sf).select(
        "run_id", "column_name", "action", "scaling", "is_override", "override_reason", "log"
    )


@query(
    "override_summary",
    f"""select run_id, count(*) as preprocess_claims, round(avg(is_override::int), 9) as override_rate,
  count(*) filter (action = 'drop') as columns_dropped, count(*) filter (action <> 'drop') as columns_kept
from ({OVERRIDE_SQL}) group by 1""",
)
def override_summary(spark, sf):
    return rounded(prep.override_summary(overridden(spark, sf)), 9)


@query(
    "metric_choice",
    """with s as (select l_suppkey as entity, case l_suppkey % 3 when 0 then 'binary' when 1 then 'multiclass' else 'regression'
  end as task_type, avg((l_returnflag = 'A')::int) < 0.33 as imbalanced, skewness(l_extendedprice) * 4 as skew
from lineitem group by 1)
select entity, case when task_type = 'binary' and imbalanced then 'pr_auc' when task_type = 'binary' then 'roc_auc'
  when task_type = 'multiclass' then 'macro_f1' when skew > 1 then 'mae' else 'rmse' end as primary_metric,
  case when task_type = 'binary' and imbalanced then 'f1,roc_auc,precision,recall' when task_type = 'binary' then
  'f1,accuracy' when task_type = 'multiclass' then 'balanced_accuracy,per_class_f1' when skew > 1 then 'rmse,r2'
  else 'mae,r2' end as secondary_metrics from s""",
)
def metric_choice(spark, sf):
    summary = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(
        (F.avg((F.col("l_returnflag") == "A").cast("double")) < 0.33).alias("imbalanced"),
        (adjusted_skew(F.col("l_extendedprice")) * 4).alias("skew"),
    )
    kinds = F.array(F.lit("binary"), F.lit("multiclass"), F.lit("regression"))
    task = F.element_at(kinds, (F.col("entity") % 3 + 1).cast("int"))
    primary, secondary = prep.metric_choice(task, F.col("imbalanced"), F.col("skew"))
    return summary.select(
        "entity", primary.alias("primary_metric"), F.array_join(secondary, ",").alias("secondary_metrics")
    )


def gappy_orders(spark, sf):
    gap = hash32(F.col("o_orderkey")) % 100
    return (
        table(spark, sf, "orders")
        .withColumn("_gap", gap)
        .select(
            "o_orderkey",
            F.expr("case when _gap >= 12 then o_totalprice end").alias("total"),
            F.expr("case when _gap >= 20 then o_custkey end").alias("cust"),
            F.expr("case when _gap >= 8 then o_orderpriority end").alias("priority"),
            "o_orderstatus",
        )
    )


GAPPY_ORDERS = f"""g as (select o_orderkey, case when {sql_hash32("o_orderkey")} % 100 >= 12 then o_totalprice end as total,
  case when {sql_hash32("o_orderkey")} % 100 >= 20 then o_custkey end as cust,
  case when {sql_hash32("o_orderkey")} % 100 >= 8 then o_orderpriority end as priority, o_orderstatus from orders)"""


@query(
    "feat_impute",
    f"""with {GAPPY_ORDERS}, f as (select avg(total) as m, quantile_cont(cust, 0.5) as md from g),
c as (select priority, count(*) as n from g where priority is not null group by 1),
mo as (select priority as mode from c order by n desc, priority limit 1)
select o_orderkey, round(coalesce(total, m), 4) as total_mean, round(coalesce(cust, md), 4) as cust_median,
  round(coalesce(total, -999), 4) as total_constant, coalesce(priority, '__MISSING__') as priority_constant,
  coalesce(priority, mode) as priority_mode, (total is null)::int as total_missing from g, f, mo""",
)
def feat_impute(spark, sf):
    frame = gappy_orders(spark, sf)
    stats = ft.fit_numeric(frame, ["total", "cust"])
    mode = ft.fit_modes(frame, ["priority"])["priority"]
    total, cust, priority = F.col("total"), F.col("cust"), F.col("priority")
    return frame.select(
        "o_orderkey",
        F.round(ft.impute(total, "mean", True, stats["total"]), 4).alias("total_mean"),
        F.round(ft.impute(cust, "median", True, stats["cust"]), 4).alias("cust_median"),
        F.round(ft.impute(total, "constant", True), 4).alias("total_constant"),
        ft.impute(priority, "constant", False).alias("priority_constant"),
        ft.impute(priority, "mode", False, mode=mode).alias("priority_mode"),
        total.isNull().cast("int").alias("total_missing"),
    )


@query(
    "feat_onehot",
    """select o_orderkey, (o_orderstatus = 'F')::int as status_F, (o_orderstatus = 'O')::int as status_O,
  (o_orderstatus = 'P')::int as status_P from orders""",
)
def feat_onehot(spark, sf):
    orders = table(spark, sf, "orders")
    known = ft.vocabulary(orders, "o_orderstatus")
    return orders.select("o_orderkey", *ft.one_hot(F.col("o_orderstatus"), known, "status"))


@query(
    "feat_onehot_unknown",
    f"""select o_orderkey, (o_orderstatus = 'F')::int as status_F, (o_orderstatus = 'O')::int as status_O
from orders where {sql_hash32("o_orderkey")} % 5 = 0""",
)
def feat_onehot_unknown(spark, sf):
    """Fit rows know two states; the third is all zeros in the held-out fold."""
    orders = table(spark, sf, "orders").withColumn("f", fold(F.col("o_orderkey"), 5))
    known = ft.vocabulary(orders.where("f <> 0 and o_orderstatus <> 'P'"), "o_orderstatus")
    return orders.where("f = 0").select("o_orderkey", *ft.one_hot(F.col("o_orderstatus"), known, "status"))


@query(
    "feat_onehot_vector",
    """with v as (select distinct p_type as t from part where p_size <= 45),
c as (select t, row_number() over (order by t) - 1 as code from v)
select p_partkey, coalesce(code, -1) as place, (select count(*) from v) as size, (code is not null)::int as ones
from part left join c on p_type = t""",
)
def feat_onehot_vector(spark, sf):
    """Part types as sparse vectors; types that only large parts have are unknown, so all zeros."""
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    codes = ft.label_codes(part.where("p_size <= 45"), "p_type")
    coded = ft.one_hot_vector(part, F.col("p_type"), codes, "hot")
    dense = vector_to_array("hot")
    return coded.select(
        "p_partkey",
        (F.array_position(dense, F.lit(1.0)) - 1).cast("bigint").alias("place"),
        F.size(dense).cast("bigint").alias("size"),
        F.aggregate(dense, F.lit(0.0), lambda a, b: a + b).cast("int").alias("ones"),
    )


@query(
    "feat_ordinal",
    """with v as (select o_orderpriority as p, row_number() over (order by o_orderpriority) - 1 as code
  from (select distinct o_orderpriority from orders where o_orderpriority <> '3-MEDIUM'))
select o_orderkey, coalesce(code, -1) as priority_code from orders left join v on o_orderpriority = p""",
)
def feat_ordinal(spark, sf):
    orders = table(spark, sf, "orders")
    codes = ft.label_codes(orders.where("o_orderpriority <> '3-MEDIUM'"), "o_orderpriority")
    coded = ft.ordinal(orders.select("o_orderkey", "o_orderpriority"), F.col("o_orderpriority"), codes, "priority_code")
    return coded.select("o_orderkey", F.col("priority_code").cast("bigint").alias("priority_code"))


@query(
    "feat_stringify",
    f"""with {GAPPY_ORDERS} select o_orderkey, case when cust is not null then cust || '.0' end as cust_text,
  coalesce(cust || '.0', '__MISSING__') as cust_filled from g""",
)
def feat_stringify(spark, sf):
    text = ft.category_text(F.col("cust"), True)
    return gappy_orders(spark, sf).select(
        "o_orderkey", text.alias("cust_text"), ft.impute(text, "constant", False).alias("cust_filled")
    )


@query(
    "feat_scale",
    """with f as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s, min(o_totalprice) as lo,
  max(o_totalprice) as hi, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.5) as md,
  quantile_cont(o_totalprice, 0.75) as q3 from orders)
select o_orderkey, round((o_totalprice - m) / s, 6) as standard, round((o_totalprice - lo) / (hi - lo), 6) as minmax,
  round((o_totalprice - md) / (q3 - q1), 6) as robust, round((7 - 7) / 1e0, 6) as constant from orders, f""",
)
def feat_scale(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(7.0).alias("same"))
    stats = ft.fit_numeric(orders, ["o_totalprice", "same"])
    x = F.col("o_totalprice")
    return orders.select(
        "o_orderkey",
        *[F.round(ft.scale(x, m, stats["o_totalprice"]), 6).alias(m) for m in ("standard", "minmax", "robust")],
        F.round(ft.scale(F.col("same"), "standard", stats["same"]), 6).alias("constant"),
    )


@query(
    "feat_target_encode",
    f"""with o as (select o_orderkey, o_custkey, (o_orderstatus = 'F')::int as y, {sql_hash32("o_orderkey")} % 5 as f
  from orders),
p as (select avg(y) as prior from o where f <> 0),
s as (select o_custkey, count(*) as n, avg(y) as m from o where f <> 0 group by 1)
select o_orderkey, round(coalesce(prior * (1 - n / (n + 10e0)) + m * (n / (n + 10e0)), prior), 9) as encoded
from o cross join p left join s on o.o_custkey = s.o_custkey where f = 0""",
)
def feat_target_encode(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        fold(F.col("o_orderkey"), 5).alias("f"),
    )
    stats, prior = ft.target_encoding(orders.where("f <> 0"), "o_custkey", "y")
    encoded = ft.apply_target_encoding(orders.where("f = 0"), stats, "o_custkey", prior, "value")
    return encoded.select("o_orderkey", F.round("value", 9).alias("encoded"))


@query(
    "feat_target_encode_oof",
    f"""with o as (select o_orderkey, o_custkey, (o_orderstatus = 'F')::int as y, {sql_hash32("o_orderkey")} % 5 as f
  from orders),
p as (select k.f, avg(o.y) as prior from (select distinct f from o) k join o on o.f <> k.f group by 1),
s as (select r.o_orderkey, count(x.y) as n, coalesce(sum(x.y), 0) as t from o r
  left join o x on x.o_custkey = r.o_custkey and x.f <> r.f group by 1)
select o.o_orderkey, round(prior * (1 - n / (n + 10e0)) + t / (n + 10e0), 9) as encoded
from o join p on o.f = p.f join s on o.o_orderkey = s.o_orderkey""",
)
def feat_target_encode_oof(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        fold(F.col("o_orderkey"), 5).alias("f"),
    )
    encoded = ft.out_of_fold_encoding(orders, "o_custkey", "y", "f", "value")
    return encoded.select("o_orderkey", F.round("value", 9).alias("encoded"))


@query(
    "feat_target_encode_nested",
    f"""with o as (select o_orderkey, o_custkey, (o_orderstatus = 'F')::int as y, {sql_hash32("o_orderkey")} % 5 as f,
  {sql_hash32("o_orderkey", "inner")} % 5 as g from orders),
h as (select distinct f as held from o),
p as (select held, k.g, avg(o.y) as prior from h cross join (select distinct g from o) k join o on o.f <> held and o.g <> k.g group by 1, 2),
s as (select r.o_orderkey, held, count(x.y) as n, coalesce(sum(x.y), 0) as t from o r join h on r.f <> held
  left join o x on x.o_custkey = r.o_custkey and x.f <> held and x.g <> r.g group by 1, 2)
select o.o_orderkey, s.held::int as held_out, round(prior * (1 - n / (n + 10e0)) + t / (n + 10e0), 9) as encoded
from o join s on o.o_orderkey = s.o_orderkey join p on p.held = s.held and p.g = o.g""",
)
def feat_target_encode_nested(spark, sf):
    """Inner folds of their own inside every outer training side."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        fold(F.col("o_orderkey"), 5).alias("f"),
        fold(F.col("o_orderkey"), 5, "inner").alias("g"),
    )
    encoded = ft.nested_encoding(orders, "o_custkey", "y", "f", "g", 5, "value")
    return encoded.select("o_orderkey", "held_out", F.round("value", 9).alias("encoded"))


@query(
    "feat_fold_statistics",
    f"""with o as (select o_totalprice as x, o_custkey as c, {sql_hash32("o_orderkey")} % 5 as f from orders)
select 'o_totalprice' as column_name, k.f::int as f, count(*) as n, round(avg(x), 4) as mean,
  round(stddev_pop(x), 4) as std from (select distinct f from o) k join o on o.f <> k.f group by k.f
union all select 'o_custkey', k.f::int, count(*), round(avg(c), 4), round(stddev_pop(c), 4)
from (select distinct f from o) k join o on o.f <> k.f group by k.f""",
)
def feat_fold_statistics(spark, sf):
    orders = table(spark, sf, "orders").withColumn("f", fold(F.col("o_orderkey"), 5))
    return rounded(ft.fold_means(orders, ["o_totalprice", "o_custkey"], "f"), 4)


@query(
    "feat_planned",
    f"""with {GAPPY_ORDERS}, h as (select *, {sql_hash32("o_orderkey")} % 5 as f from g),
m as (select avg(total) as m from h where f <> 0),
s as (select avg(coalesce(total, m)) as c, stddev_pop(coalesce(total, m)) as w from h, m where f <> 0),
z as (select quantile_cont(cust, 0.5) as md from h where f <> 0),
r as (select quantile_cont(coalesce(cust, md), 0.25) as q1, quantile_cont(coalesce(cust, md), 0.5) as q2,
  quantile_cont(coalesce(cust, md), 0.75) as q3 from h, z where f <> 0),
v as (select p, row_number() over (order by p) - 1 as code from (select distinct coalesce(priority, '__MISSING__') as p
  from h where f <> 0))
select o_orderkey, (total is null)::int as total_missing, round((coalesce(total, m) - c) / w, 6) as total,
  round((coalesce(cust, md) - q2) / (q3 - q1), 6) as cust, coalesce(code, -1) as priority,
  (o_orderstatus = 'F')::int as o_orderstatus_F, (o_orderstatus = 'O')::int as o_orderstatus_O,
  (o_orderstatus = 'P')::int as o_orderstatus_P
from h cross join m cross join s cross join z cross join r left join v on coalesce(priority, '__MISSING__') = p
where f = 0""",
)
def feat_planned(spark, sf):
    """A whole plan fitted on four folds and applied to the fifth."""
    frame = gappy_orders(spark, sf).withColumn("f", fold(F.col("o_orderkey"), 5))
    specs = [
        ft.ColumnSpec("total", "mean", "none", "standard", add_indicator=True),
        ft.ColumnSpec("cust", "median", "none", "robust"),
        ft.ColumnSpec("priority", "constant", "ordinal"),
        ft.ColumnSpec("o_orderstatus", "none", "onehot"),
    ]
    made = ft.transform(frame.where("f <> 0"), frame.where("f = 0"), specs, ["o_orderkey"])
    return rounded(made.withColumn("priority", F.col("priority").cast("bigint")))


@query(
    "eval_label_codes",
    """select o_orderpriority, row_number() over (order by o_orderpriority) - 1 as code
from (select distinct o_orderpriority from orders)""",
)
def eval_label_codes(spark, sf):
    return ft.label_codes(table(spark, sf, "orders"), "o_orderpriority")
