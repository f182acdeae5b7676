"""Defect planting, sampling, sentinel and preflight queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalog.gold import runs
from plumbline.catalog.profiling import rounded
from plumbline.catalog.registry import query, sql_normal, table
from plumbline.operators import corruption as cor
from plumbline.operators import quality, sampling
from plumbline.plans import audit

def priced_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")


LEAK_SQL = f"""with z as (select o_orderkey, o_totalprice as y, {sql_normal("o_orderkey", "leak")} as z from orders),
m as (select avg(y) as my, avg(z) as mz, var_pop(y) as vy, var_pop(z) as vz, covar_pop(y, z) as c from z),
l as (select o_orderkey, y, y + ((z - mz) - (y - my) * c / vy) * sqrt(vy) * sqrt(1 / (0.99e0 * 0.99e0) - 1)
  / sqrt(vz - c * c / vy) as leaked from z, m)"""


@query(
    "inject_guards",
    """with g as (select 'orders' as frame, o_totalprice as t from orders
  union all select 'gaps', case when o_orderkey % 7 <> 0 then o_totalprice end from orders
  union all select 'same', o_totalprice - o_totalprice from orders
  union all select 'reserved', o_totalprice from orders),
a as (select frame, count(*) - count(t) as gaps, (min(t) = max(t))::bigint as same from g group by 1
  union all select 'no target', count(*), 1 from orders)
select frame, 'target_present' as rule, (frame = 'no target')::bigint as failing from a
union all select frame, 'names_free', case when frame = 'reserved' then 2::bigint else 0 end from a
union all select frame, 'target_complete', gaps from a union all select frame, 'target_varies', same from a""",
)
def inject_guards(spark, sf):
    """What the guards say of orders as they are and of four frames that can't be planted."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    frames = {
        "orders": orders,
        "gaps": orders.withColumn("o_totalprice", F.expr("case when o_orderkey % 7 <> 0 then o_totalprice end")),
        "same": orders.withColumn("o_totalprice", F.expr("o_totalprice - o_totalprice")),
        "reserved": orders.withColumns({cor.CONSTANT: F.lit(1), cor.LEAKED: F.lit(2)}),
        "no target": orders.drop("o_totalprice"),
    }
    told = [cor.source_problems(f, "o_totalprice").withColumn("frame", F.lit(name)) for name, f in frames.items()]
    return reduce(DataFrame.unionByName, told)


@query("inject_leak_numeric", f"{LEAK_SQL} select o_orderkey, round(leaked, 3) as leaked from l")
def inject_leak_numeric(spark, sf):
    leaked = cor.leak_numeric(priced_orders(spark, sf), "o_totalprice", "o_orderkey")
    return leaked.select("o_orderkey", F.round(cor.LEAKED, 3).alias("leaked"))


@query(
    "inject_leak_label",
    """with k as (select o_orderkey, o_orderstatus, row_number() over (order by md5(o_orderkey || '|flip'), o_orderkey) as r,
  greatest(1, cast(round_even(count(*) over () * 0.005, 0) as bigint)) as flips from orders)
select o_orderkey, case when r > flips then o_orderstatus when o_orderstatus = 'F' then 'O' when o_orderstatus = 'O'
  then 'P' else 'F' end as leaked from k""",
)
def inject_leak_label(spark, sf):
    leaked = cor.leak_label(priced_orders(spark, sf), "o_orderstatus", "o_orderkey")
    return leaked.select("o_orderkey", F.col(cor.LEAKED).alias("leaked"))


@query(
    "inject_missing",
    f"""with k as (select o_orderkey, row_number() over (order by md5(o_orderkey || '|missing'), o_orderkey) as r,
  cast(round_even(count(*) over () * 0.6, 0) as bigint) as gone, {sql_normal("o_orderkey", "high_missing")} as z
  from orders)
select o_orderkey, case when r > gone then round(z, 6) end as value from k""",
)
def inject_missing(spark, sf):
    planted = cor.plant_missing(priced_orders(spark, sf), "o_orderkey")
    return planted.select("o_orderkey", F.round(cor.HIGH_MISSING, 6).alias("value"))


@query(
    "inject_report",
    f"""{LEAK_SQL}, g as (select cast(round_even(count(*) * 0.6, 0) as bigint) as gone, count(*) as n from orders)
select 1::bigint as constant_nunique, round(corr(leaked, y), 9) as leaked_corr_with_target,
  round(any_value(gone) * 100e0 / any_value(n), 6) as high_missing_pct from l, g""",
)
def inject_report(spark, sf):
    planted = cor.plant_defects(priced_orders(spark, sf), "o_totalprice", "o_orderkey")
    report = cor.corruption_report(planted, "o_totalprice")
    return report.select(
        "constant_nunique",
        F.round("leaked_corr_with_target", 9).alias("leaked_corr_with_target"),
        F.round("high_missing_pct", 6).alias("high_missing_pct"),
    )


DEFECTS = {
    "constant": "col:a:is_constant",
    "leakage": "col:b:leakage_suspect",
    "high_missing": "col:c:has_high_missing",
}


def recall_inputs(spark, sf):
    key = (
        F.when(F.col("l_linenumber") == 1, "col:a:is_constant")
        .when(F.col("l_linenumber") == 2, "col:b:leakage_suspect")
        .when(F.col("l_linenumber") == 3, "col:c:has_high_missing")
        .otherwise("col:d:mean")
    )
    owner = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("run_id"), "o_orderpriority"
    )
    evidence = (
        table(spark, sf, "lineitem")
        .select(
            F.col("l_orderkey").alias("claim_id"),
            key.alias("metric_key"),
            (F.col("l_returnflag") == "R").alias("claimed_bool"),
        )
        .join(owner.drop("o_orderpriority"), "claim_id")
    )
    claims = audit.derived_severity(owner.drop("o_orderpriority"), evidence, ["run_id", "claim_id"])
    return evidence, claims.withColumnRenamed("rule_derived_severity", "severity")


MATCH_SQL = """with e as (select o_custkey as run_id, l_orderkey as claim_id, case l_linenumber when 1 then 'constant'
  when 2 then 'leakage' when 3 then 'high_missing' end as defect, l_returnflag = 'R' as claimed
  from lineitem join orders on l_orderkey = o_orderkey),
c as (select claim_id from e where claimed and defect is not null group by 1),
m as (select distinct run_id, defect, e.claim_id from e join c on e.claim_id = c.claim_id where defect is not null)"""


@query("defect_matches", f"{MATCH_SQL} select run_id, defect, claim_id from m")
def defect_matches(spark, sf):
    return cor.defect_matches(*recall_inputs(spark, sf), DEFECTS)


@query(
    "defect_recall",
    f"""{MATCH_SQL}, n as (select run_id, defect, count(*) as k from m group by 1, 2)
select c_custkey as run_id, d.defect, expected_metric_key, coalesce(k, 0) as matching_claims, coalesce(k, 0) > 0 as recalled
from customer cross join (values ('constant', 'col:a:is_constant'), ('leakage', 'col:b:leakage_suspect'),
  ('high_missing', 'col:c:has_high_missing')) d(defect, expected_metric_key)
left join n on n.run_id = c_custkey and n.defect = d.defect""",
)
def defect_recall(spark, sf):
    evidence, claims = recall_inputs(spark, sf)
    return cor.defect_recall(cor.defect_matches(evidence, claims, DEFECTS), runs(spark, sf), DEFECTS)


@query(
    "sample_k",
    """select p_partkey, p_name from part
qualify row_number() over (order by md5(p_partkey || '|sample42'), p_partkey) <= count(*) over () // 10""",
)
def sample_k(spark, sf):
    """A sample of exactly a tenth of the parts."""
    parts = table(spark, sf, "part")
    return sampling.sample_exact(parts, "p_partkey", parts.count() // 10, 42).select("p_partkey", "p_name")


SENTINEL = """s as (select p_partkey, case when p_size = 50 then 365243 else p_size end as days from part)"""


def employed(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") == 50, 365243).otherwise(F.col("p_size")).alias("days")
    )


@query(
    "sentinel_fix",
    f"""with {SENTINEL} select p_partkey, case when days <> 365243 then days end as days, days = 365243 as "days_ANOM" from s""",
)
def sentinel_fix(spark, sf):
    fixed, _ = cor.replace_sentinel(employed(spark, sf), "days", 365243)
    return fixed


@query(
    "sentinel_audit",
    f"""with {SENTINEL} select 'days' as column_name, 365243e0 as sentinel_value, count(*) filter (days = 365243) as rows_corrected,
  round(avg(days), 6) as raw_mean, round(avg(case when days <> 365243 then days end), 6) as cleaned_mean,
  'days_ANOM' as indicator_column from s""",
)
def sentinel_audit(spark, sf):
    _, report = cor.replace_sentinel(employed(spark, sf), "days", 365243)
    return rounded(report)


@query(
    "planted_frame_check",
    """with o as (select o_orderkey as k, o_totalprice as t from orders),
g as (select 'good' as frame, k, t from o
  union all select 'changed_target', k, case when k % 1000 = 7 then t + 1 else t end from o
  union all select 'lost_rows', k, t from o where k % 2 = 0),
d as (select frame, k, t, count(*) as n from g group by all),
b as (select k, t, count(*) as n from o group by all),
x as (select f.frame, count(*) filter (d.n is distinct from b.n) as wrong, count(*) filter (d.n is null) as gone
  from (select distinct frame from g) f join b on true left join d on d.frame = f.frame and d.k = b.k
  and d.t is not distinct from b.t group by 1)
select frame, 'must keep every row and the target' as problem from x where wrong > 0""",
)
def planted_frame_check(spark, sf):
    """Three planted frames, two of them wrong."""
    orders = priced_orders(spark, sf).drop("o_orderstatus")
    good = orders.withColumns({c: F.lit(1) for c in cor.COLUMNS})
    frames = {
        "good": good,
        "changed_target": good.withColumn(
            "o_totalprice", F.expr("case when o_orderkey % 1000 = 7 then o_totalprice + 1 else o_totalprice end")
        ),
        "lost_rows": good.where("o_orderkey % 2 = 0"),
    }
    found = [
        (name, problem)
        for name, frame in frames.items()
        for problem in quality.planted_frame_problems(orders, frame, "o_orderkey", "o_totalprice")
    ]
    return spark.createDataFrame(found, "frame string, problem string")
