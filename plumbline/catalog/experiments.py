"""Queries across runs. Datasets are market segments, runs are customers, claims are orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.gold import rounded, runs
from plumbline.catalog.registry import query, table
from plumbline.plans import experiments as ex


def scores(spark, sf):
    claims = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderpriority").alias("stage"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 4).alias("layer2_score"),
    )
    per_run = claims.groupBy("run_id", "stage").agg(F.avg("layer2_score").alias("run_mean"))
    return per_run.join(runs(spark, sf).select("run_id", "dataset", "temperature"), "run_id")


RUN_MEANS = """m as (select c_mktsegment as dataset, o_custkey as run_id, c_nationkey % 2 = 0 as cold, o_orderpriority as stage,
  avg(case when o_orderstatus <> 'P' then o_orderkey % 4 end) as run_mean
  from orders join customer on o_custkey = c_custkey group by 1, 2, 3, 4)"""


@query(
    "stage_mean_std",
    f"""with {RUN_MEANS} select dataset, stage, count(run_mean) as runs, round(avg(run_mean), 9) as mean_layer2_score,
  round(stddev_pop(run_mean), 9) as std_layer2_score from m where cold group by 1, 2""",
)
def stage_mean_std(spark, sf):
    return rounded(ex.stage_mean_std(scores(spark, sf)))


@query(
    "temperature_delta",
    f"""with {RUN_MEANS}, d as (select dataset, stage, avg(run_mean) filter (cold) as c, avg(run_mean) filter (not cold) as w
  from m group by 1, 2)
select dataset, stage, round(c, 9) as cold_mean, round(w, 9) as warm_mean, round(abs(w - c), 9) as delta,
  abs(w - c) >= 0.25 as notable from d""",
)
def temperature_delta(spark, sf):
    return rounded(ex.temperature_delta(scores(spark, sf)))


def decisions(spark, sf, cold):
    wanted = runs(spark, sf).where("temperature = 0.0" if cold else "temperature <> 0.0").select("run_id", "dataset")
    taken = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.when(F.col("o_orderpriority") < "3", "high").otherwise("low").alias("stage"),
        F.when(F.col("o_orderstatus") == "F", "F").otherwise("open").alias("decision"),
    )
    nations = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), "c_nationkey")
    return taken.distinct().join(wanted, "run_id").join(nations, "run_id")


DECISIONS = """t as (select distinct c_mktsegment as dataset, c_nationkey, c_nationkey % 2 = 0 as cold, o_custkey as run_id,
  case when o_orderpriority < '3' then 'high' else 'low' end as stage,
  case when o_orderstatus = 'F' then 'F' else 'open' end as decision from orders join customer on o_custkey = c_custkey),
g as (select dataset, c_nationkey, cold, count(distinct run_id) as n from t group by 1, 2, 3),
k as (select dataset, c_nationkey, cold, stage, decision, count(*) as n from t group by 1, 2, 3, 4, 5),
s as (select k.dataset, k.c_nationkey, k.cold, stage, decision from k join g on k.dataset = g.dataset
  and k.c_nationkey = g.c_nationkey and k.n = g.n)"""


@query("consensus_decisions", f"with {DECISIONS} select dataset, c_nationkey, stage, decision from s where cold")
def consensus_decisions(spark, sf):
    return ex.consensus(decisions(spark, sf, True), ["dataset", "c_nationkey"])


CHANGES = f"""{DECISIONS}, a as (select distinct dataset, stage, decision from s where cold),
b as (select distinct dataset, stage, decision from s where not cold),
u as (select * from (select * from a except select * from b) union all select * from (select * from b except select * from a)),
d as (select distinct dataset from (select * from a union all select * from b)),
c as (select d.dataset, count(u.stage) as changed_decisions from d left join u on d.dataset = u.dataset group by 1)"""


@query("changed_decisions", f"with {CHANGES} select * from c")
def changed_decisions(spark, sf):
    by = ["dataset", "c_nationkey"]
    cold = ex.consensus(decisions(spark, sf, True), by).select("dataset", "stage", "decision")
    warm = ex.consensus(decisions(spark, sf, False), by).select("dataset", "stage", "decision")
    return ex.changed_decisions(cold, warm, ["dataset"])


@query(
    "variance_note",
    f"""with {RUN_MEANS}, {CHANGES}, e as (select dataset, stage, abs(avg(run_mean) filter (not cold)
  - avg(run_mean) filter (cold)) as delta from m group by 1, 2),
n as (select dataset, coalesce(string_agg(stage, ', ' order by stage) filter (delta >= 0.25), '') as stages from e group by 1)
select dataset, case when stages <> '' or coalesce(changed_decisions, 0) > 0 then 'Notable variance: score delta >=0.25 in ['
  || stages || ']; ' || coalesce(changed_decisions, 0) || ' consensus decision entries differed.'
  else 'No notable variance in stage means or consensus decisions at temperature 0.7.' end as temp07_variance_note
from n left join c using (dataset)""",
)
def variance_note(spark, sf):
    """Sentences from the score deltas and from the decisions that both temperatures agree on or not."""
    return ex.variance_note(ex.temperature_delta(scores(spark, sf)), changed_decisions(spark, sf))


@query(
    "pattern_counts",
    """select source as run_id, count(*) filter (quality = 1
    and regexp_matches(lower(text), 'risk|overfit|overfitting|high[ -]variance')
    and regexp_matches(lower(text), 'contradict|inconsisten|despite|yet select|still select|reconcil'))
  as select_despite_risk_count, count(*) filter (quality = 0
    and regexp_matches(lower(text), 'unsupported|not supported|not evidenced|invent')
    and regexp_matches(lower(text), 'business|domain|outcome|narrative|real-world|context'))
  as invented_narrative_count
from labels join (select doc_id, source, replace(replace(text, 'the', 'risk invent'), 'and', 'despite domain') as text
  from documents) using (doc_id) group by 1""",
)
def pattern_counts(spark, sf):
    """Critic notes are document texts, with two common words standing in for the patterns."""
    stage = F.when(F.col("quality") == 1, "model_selection").otherwise("evaluation")
    claims = table(spark, sf, "labels").select(F.col("doc_id").alias("claim_id"), stage.alias("stage"))
    note = F.replace(
        F.replace(F.col("text"), F.lit("the"), F.lit("risk invent")), F.lit("and"), F.lit("despite domain")
    )
    verdicts = table(spark, sf, "documents").select(
        F.col("doc_id").alias("claim_id"), F.col("source").alias("run_id"), note.alias("discrepancy_note")
    )
    return ex.pattern_counts(claims, verdicts, ["run_id"], ["claim_id"])


@query(
    "note_patterns",
    """select doc_id, regexp_matches(lower(text), 'risk|overfit|overfitting|high[ -]variance') and
  regexp_matches(lower(text), 'contradict|inconsisten|despite|yet select|still select|reconcil') as despite_risk,
  regexp_matches(lower(text), 'unsupported|not supported|not evidenced|invent') and
  regexp_matches(lower(text), 'business|domain|outcome|narrative|real-world|context') as invented from documents""",
)
def note_patterns(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        ex.selects_despite_risk(F.col("text")).alias("despite_risk"),
        ex.invents_narrative(F.col("text")).alias("invented"),
    )


@query(
    "matrix_plan",
    """select lower(c_mktsegment) as dataset, arm, temperature, repeat, 'm9_' || lower(c_mktsegment) || '_' || arm || '_' ||
  case when temperature = 0 then 't00' else 't07' end || '_r' || repeat as run_id
from (select distinct c_mktsegment from customer), (values ('ab', 0.0e0, 1::bigint), ('ab', 0.0e0, 2), ('ab', 0.0e0, 3),
  ('ab', 0.7e0, 1), ('c', 0.0e0, 1)) m(arm, temperature, repeat)""",
)
def matrix_plan(spark, sf):
    datasets = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("dataset")).distinct()
    return ex.planned_runs(datasets)


@query(
    "call_budget",
    """select p_size as columns, p_size + 13 + ceil(p_size / 15e0)::bigint as low, p_size + 20 + ceil(p_size / 15e0)::bigint as high,
  floor(28 + 1.12e0 * p_size)::bigint as cap from (select distinct p_size from part)""",
)
def call_budget(spark, sf):
    low, high, cap = ex.call_budget(F.col("columns"))
    sizes = table(spark, sf, "part").select(F.col("p_size").alias("columns")).distinct()
    return sizes.select("columns", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), cap.cast("bigint").alias("cap"))


def compared(spark, sf):
    """Expected plans from orders, actual plans for two thirds of them."""
    key = F.col("o_orderkey")
    keys = [F.col("o_custkey").alias("run_id"), F.concat(F.lit("c"), key.cast("string")).alias("column_name")]
    orders = table(spark, sf, "orders")
    expected = orders.select(
        *keys,
        F.when(key % 4 == 0, "drop").otherwise("scale").alias("action"),
        F.when(key % 2 == 0, "mean").alias("imputation"),
        F.when(key % 5 == 0, "onehot_or_ordinal_by_cardinality").otherwise("none").alias("encoding"),
        F.when(key % 7 == 0, "standard_or_robust_by_skew").otherwise("minmax").alias("scaling"),
    )
    actual = orders.where("o_orderkey % 3 <> 0").select(
        *keys,
        F.when(key % 8 == 0, "drop").when(key % 11 == 0, "drop").otherwise("scale").alias("action"),
        F.when(key % 6 == 2, "mean").otherwise("none").alias("imputation"),
        F.when(key % 10 == 0, "ordinal").otherwise("none").alias("encoding"),
        F.when(key % 7 == 0, "robust").otherwise("minmax").alias("scaling"),
    )
    return ex.compare_plans(expected, actual, ["run_id", "column_name"])


COMPARED = """(select o_custkey as run_id, o_orderkey as k, o_orderkey % 3 <> 0 as planned, o_orderkey % 4 = 0 as e_drop,
  o_orderkey % 3 <> 0 and (o_orderkey % 8 = 0 or o_orderkey % 11 = 0) as a_drop,
  o_orderkey % 3 <> 0 and (o_orderkey % 4 = 0) = (o_orderkey % 8 = 0 or o_orderkey % 11 = 0)
    and (o_orderkey % 2 <> 0 or o_orderkey % 6 = 2) and (o_orderkey % 5 <> 0 or o_orderkey % 10 = 0) as matches from orders)"""


@query("plan_comparison", f"select run_id, 'c' || k as column_name, matches from {COMPARED}")
def plan_comparison(spark, sf):
    return compared(spark, sf).select("run_id", "column_name", "matches")


AGREEMENT = f"""(select run_id, count(*) filter (matches) as column_plan_matches, count(*) as column_plans_scored,
  count(*) filter (matches) / (count(*) * 1e0) as rate, count(*) filter (e_drop and not a_drop) as expected_drop_but_kept,
  count(*) filter (not e_drop and a_drop) as expected_keep_but_dropped from {COMPARED} group by 1)"""


@query(
    "plan_agreement",
    f"""select run_id, column_plan_matches, column_plans_scored, round(rate, 9) as column_plan_agreement_rate,
  expected_drop_but_kept, expected_keep_but_dropped from {AGREEMENT}""",
)
def plan_agreement(spark, sf):
    return rounded(ex.plan_agreement(compared(spark, sf), ["run_id"]))


@query(
    "plan_unscored",
    "select o_custkey as run_id, o_orderkey as column_name from orders where o_orderstatus = 'P'",
)
def plan_unscored(spark, sf):
    plans = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("column_name"), "o_orderstatus"
    )
    return ex.unscored_columns(plans.where("o_orderstatus <> 'P'"), plans, ["run_id", "column_name"])


@query(
    "agreement_rollup",
    f"""select c_mktsegment as dataset, count(*) as temp0_runs_compared, round(avg(rate), 9) as column_plan_agreement_rate,
  round(avg((run_id % 2 = 0)::int), 9) as top_model_match_rate, round(avg((run_id % 3 = 0)::int), 9) as ranking_exact_match_rate,
  round(avg((run_id % 5 = 0)::int), 9) as rejected_model_match_rate, round(avg((run_id % 7 = 0)::int), 9) as metric_match_rate
from {AGREEMENT} join customer on run_id = c_custkey where c_nationkey % 2 = 0 group by 1""",
)
def agreement_rollup(spark, sf):
    key = F.col("run_id")
    rates = ex.plan_agreement(compared(spark, sf), ["run_id"]).withColumns(
        {
            "top_model_match": key % 2 == 0,
            "ranking_exact_match": key % 3 == 0,
            "rejected_model_match": key % 5 == 0,
            "metric_match": key % 7 == 0,
        }
    )
    cold = runs(spark, sf).where("temperature = 0.0").select("run_id", "dataset")
    return rounded(ex.agreement_rollup(rates.join(cold, "run_id"), ["dataset"]))


def brand_defects(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_linenumber")
    return parts.join(lines, parts.p_partkey == lines.l_partkey).select(
        F.col("p_brand").alias("dataset"),
        F.concat("p_type", (F.col("p_partkey") % 40).cast("string")).alias("defect"),
        (F.col("l_linenumber") != 7).alias("recalled"),
    )


RECALL = """(select p_brand as dataset, p_type || (p_partkey % 40) as defect, bool_and(l_linenumber <> 7) as always
  from part join lineitem on p_partkey = l_partkey group by 1, 2)"""


@query(
    "consistent_recall",
    f"""select dataset, count(*) filter (always) as recalled_defects, count(*) as planted_defects from {RECALL} group by 1""",
)
def consistent_recall(spark, sf):
    return ex.consistent_recall(brand_defects(spark, sf))


@query(
    "overall_recall",
    f"""select count(*) filter (always) as recalled, count(*) as planted, round(avg(always::int), 9) as overall_recall_rate
from {RECALL}""",
)
def overall_recall(spark, sf):
    return rounded(ex.overall_recall(ex.consistent_recall(brand_defects(spark, sf))))


@query(
    "lowest_stage_count",
    f"""with {RUN_MEANS}, s as (select dataset, stage, avg(run_mean) as v from m where cold group by 1, 2),
d as (select dataset, max(v) filter (stage = '2-HIGH') as own, min(v) filter (stage <> '2-HIGH') as others from s group by 1)
select count(*) filter (own < others) as lowest_in, count(*) as datasets from d""",
)
def lowest_stage_count(spark, sf):
    return ex.lowest_stage_count(ex.stage_mean_std(scores(spark, sf)), "2-HIGH")


@query(
    "alias_columns",
    """select p_partkey, case p_type when 'ECONOMY' then 'economy type' when 'STANDARD' then 'standard type' else p_type end
  as column_name from part""",
)
def alias_columns(spark, sf):
    plans = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("column_name"))
    return ex.apply_aliases(plans, {"ECONOMY": "economy type", "STANDARD": "standard type"})
