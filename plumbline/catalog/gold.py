"""Gold, report and quality queries.

Runs are customers, claims are orders, evidence verdicts are line items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.audit import flag_code
from plumbline.catalog.registry import query, table
from plumbline.operators import joins, quality
from plumbline.plans import audit, gold


def runs(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"),
        F.col("c_mktsegment").alias("dataset"),
        F.when(F.col("c_nationkey") % 2 == 0, 0.0).otherwise(0.7).alias("temperature"),
        F.when(F.col("c_nationkey") % 5 == 0, "c").otherwise("ab").alias("arm"),
        (F.col("c_custkey") % 3 + 1).alias("repeat"),
        F.lit("y").alias("target_column"),
    )


RUNS = """(select c_custkey as run_id, c_mktsegment as dataset, case when c_nationkey % 2 = 0 then 0.0e0 else 0.7e0 end
  as temperature, case when c_nationkey % 5 = 0 then 'c' else 'ab' end as arm, c_custkey % 3 + 1 as repeat
  from customer)"""


def claims(spark, sf):
    decision = F.concat_ws(
        "|", "o_orderpriority", (F.col("o_orderkey") % 50).cast("string"), F.lit("accept")
    )
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_orderpriority").alias("stage"),
        F.when(F.col("o_orderkey") % 9 != 0, decision).alias("decision_key"),
    )


def evidence(spark, sf):
    """Line items as verdicts; the run of a verdict comes from its order."""
    keys = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("claim_id")
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"), flag_code().alias("layer1_code")
    )
    return lines.join(keys, "claim_id")


def layer2(spark, sf):
    return (
        table(spark, sf, "orders")
        .where("o_orderstatus <> 'P'")
        .select(
            F.col("o_custkey").alias("run_id"),
            F.col("o_orderkey").alias("claim_id"),
            (F.col("o_orderkey") % 4).alias("layer2_score"),
        )
    )


def layer1(spark, sf):
    """Claim codes, for claims that have citations."""
    counts = audit.citation_counts(evidence(spark, sf), ["run_id", "claim_id"])
    code = (
        F.when(F.col("fabricated") > 2, audit.FABRICATED)
        .when(F.col("misstated") > 1, audit.MISSTATED)
        .otherwise(audit.ACCURATE)
    )
    return counts.select("run_id", "claim_id", code.alias("claim_layer1_code"))


def enriched(spark, sf):
    return joins.enrich_claims(claims(spark, sf), layer1(spark, sf), layer2(spark, sf))


ENRICHED = """(select o_custkey as run_id, o_orderkey as claim_id, o_orderpriority as stage,
  case when o_orderkey % 9 <> 0 then o_orderpriority || '|' || (o_orderkey % 50) || '|accept' end as decision_key,
  case when l_orderkey is null then null when f > 2 then 'FABRICATED_EVIDENCE' when m > 1 then 'EVIDENCE_MISSTATED'
    else 'EVIDENCE_ACCURATE' end as claim_layer1_code,
  case when o_orderstatus <> 'P' then o_orderkey % 4 end as layer2_score
from orders left join (select l_orderkey, count(*) filter (l_returnflag = 'N') as m,
  count(*) filter (l_returnflag not in ('A', 'N')) as f from lineitem group by 1) on o_orderkey = l_orderkey)"""


def rounded(frame, digits=9):
    return frame.select(
        *[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
          for f in frame.schema.fields]
    )


@query(
    "gold_verdict_rates",
    """select c_mktsegment as dataset, o_orderpriority as stage, count(*) as evidence_count,
  count(*) filter (l_returnflag = 'A') as accurate_count, count(*) filter (l_returnflag = 'N') as misstated_count,
  count(*) filter (l_returnflag not in ('A', 'N')) as fabricated_count,
  round(avg((l_returnflag = 'A')::int), 9) as accuracy_rate,
  round(avg((l_returnflag = 'N')::int), 9) as misstatement_rate,
  round(avg((l_returnflag not in ('A', 'N'))::int), 9) as fabrication_rate
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2""",
)
def gold_verdict_rates(spark, sf):
    return rounded(gold.verdict_rates(evidence(spark, sf), claims(spark, sf), runs(spark, sf)))


@query(
    "gold_audited_rates",
    """with v as (select o_custkey, o_orderpriority as stage, case when t.l_orderkey is null then 'F'
    when abs(o_totalprice - total) / (case when total = 0 then 1e-8 else abs(total) end) <= 0.01 then 'A' else 'M' end as c
  from orders left join (select l_orderkey, sum(l_extendedprice) as total from lineitem group by 1) t
    on o_orderkey = t.l_orderkey)
select c_mktsegment as dataset, stage, count(*) as evidence_count, count(*) filter (c = 'A') as accurate_count,
  count(*) filter (c = 'M') as misstated_count, count(*) filter (c = 'F') as fabricated_count,
  round(avg((c = 'A')::int), 9) as accuracy_rate, round(avg((c = 'M')::int), 9) as misstatement_rate,
  round(avg((c = 'F')::int), 9) as fabrication_rate
from v join customer on o_custkey = c_custkey group by 1, 2""",
)
def gold_audited_rates(spark, sf):
    """Audit end to end: claimed order totals, verdicts, rates by dataset and stage."""
    from plumbline.catalog.audit import audited_totals

    verdicts = audited_totals(spark, sf)
    return rounded(gold.verdict_rates(verdicts.drop("stage"), claims(spark, sf), runs(spark, sf)))


SCORE_SQL = f"""select dataset, stage, temperature, count(*) as claim_count,
  count(*) filter (claim_layer1_code = 'EVIDENCE_ACCURATE') as layer1_eligible_count,
  count(layer2_score) as layer2_claim_count, round(avg(layer2_score), 9) as mean_layer2_score,
  count(*) filter (layer2_score = 0) as score_0_count, count(*) filter (layer2_score = 1) as score_1_count,
  count(*) filter (layer2_score = 2) as score_2_count, count(*) filter (layer2_score = 3) as score_3_count,
  count(*) filter (claim_layer1_code = 'EVIDENCE_ACCURATE' and layer2_score is null) as eligible_missing_layer2_count,
  count(*) filter (claim_layer1_code <> 'EVIDENCE_ACCURATE' and layer2_score is not null)
    as ineligible_with_layer2_count,
  count(*) filter (claim_layer1_code = 'EVIDENCE_MISSTATED' and layer2_score is null)
    as evidence_misstated_excluded_count
from {ENRICHED} e join {RUNS} r on e.run_id = r.run_id group by 1, 2, 3"""


@query("gold_scores", SCORE_SQL)
def gold_scores(spark, sf):
    return rounded(gold.layer2_scores(enriched(spark, sf), runs(spark, sf)))


@query(
    "score_coverage",
    f"""select cast(sum(layer1_eligible_count) as bigint) as layer1_eligible_claims,
  cast(sum(layer2_claim_count) as bigint) as layer2_verdicts,
  cast(sum(eligible_missing_layer2_count) as bigint) as eligible_without_layer2,
  cast(sum(ineligible_with_layer2_count) as bigint) as ineligible_with_layer2,
  cast(sum(evidence_misstated_excluded_count) as bigint) as evidence_misstated_excluded from ({SCORE_SQL})""",
)
def score_coverage(spark, sf):
    return gold.coverage_totals(gold.layer2_scores(enriched(spark, sf), runs(spark, sf)))


@query(
    "score_weighted_mean",
    f"""select stage, temperature, count(layer2_score) as scored_claims, round(avg(layer2_score), 9) as mean_layer2_score,
  count(*) filter (layer2_score = 0) as score_0_count, count(*) filter (layer2_score = 1) as score_1_count,
  count(*) filter (layer2_score = 2) as score_2_count, count(*) filter (layer2_score = 3) as score_3_count
from {ENRICHED} e join {RUNS} r on e.run_id = r.run_id group by 1, 2""",
)
def score_weighted_mean(spark, sf):
    return rounded(gold.weighted_mean_scores(gold.layer2_scores(enriched(spark, sf), runs(spark, sf))))


def defects(spark, sf):
    """Line items as planted defects: the part brand is the column, the flag is the outcome."""
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("column_name"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    owner = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("run_id"))
    recalled = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(owner, lines.l_orderkey == owner.o_orderkey)
        .select("run_id", F.col("l_linestatus").alias("defect"), "column_name", recalled.alias("recalled"))
    )


DETECTION_SQL = """select c_mktsegment as dataset, l_linestatus as defect, count(*) as planted_count,
  count(*) filter (l_returnflag = 'A') as detected_count,
  coalesce(string_agg(distinct case when l_returnflag = 'R' then p_brand end, ',' order by
    case when l_returnflag = 'R' then p_brand end), '') as missed_columns,
  round(count(*) filter (l_returnflag = 'A') / (count(*) * 1e0), 9) as detection_rate
from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey group by 1, 2"""


def detection(spark, sf):
    return gold.detection(defects(spark, sf), runs(spark, sf))


@query("gold_detection", DETECTION_SQL)
def gold_detection(spark, sf):
    return rounded(detection(spark, sf)).withColumn("missed_columns", F.array_join("missed_columns", ","))


@query(
    "detection_totals",
    f"""select dataset, defect, planted_count, detected_count,
  cast(sum(detected_count) over () as bigint) as all_detected,
  cast(sum(planted_count) over () as bigint) as all_planted from ({DETECTION_SQL})""",
)
def detection_totals(spark, sf):
    return gold.detection_totals(detection(spark, sf)).drop("missed_columns", "detection_rate")


PER_RUN_SQL = f"""select dataset, decision_key, e.run_id, max(layer2_score) as layer2_score
from {ENRICHED} e join {RUNS} r on e.run_id = r.run_id
where temperature = 0 and decision_key is not null and layer2_score is not null group by 1, 2, 3"""


@query(
    "gold_consistency",
    f"""select dataset, decision_key, count(*) as run_count, count(*) filter (layer2_score = 0) as score_0_count,
  count(*) filter (layer2_score = 1) as score_1_count, count(*) filter (layer2_score = 2) as score_2_count,
  count(*) filter (layer2_score = 3) as score_3_count, min(layer2_score) as min_layer2_score,
  max(layer2_score) as max_layer2_score, max(layer2_score) - min(layer2_score) as score_spread
from ({PER_RUN_SQL}) group by 1, 2 having count(*) >= 2""",
)
def gold_consistency(spark, sf):
    table_ = gold.decision_consistency(gold.per_run_decision(enriched(spark, sf), runs(spark, sf)))
    return table_.orderBy(F.desc("score_spread"), "dataset", "decision_key")


@query("gold_consistency_by_run", PER_RUN_SQL)
def gold_consistency_by_run(spark, sf):
    return gold.per_run_decision(enriched(spark, sf), runs(spark, sf))


def run_metrics(spark, sf):
    n = F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("c_custkey") % 3 + 1).cast("int")).alias(
            "reported_arm"
        ),
        F.when(n % 4 != 0, F.concat(F.lit("m"), (n % 4).cast("string"))).alias("best_model_id"),
        F.col("c_acctbal").alias("best_primary_metric_value"),
        (n / 100.0).alias("override_rate"),
        F.lit(0.5).alias("mean_layer2_score"),
    )


def evaluations(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_custkey").alias("run_id"),
            F.concat(F.lit("m"), (F.col("o_orderkey") % 5).cast("string")).alias("model_id"),
        )
        .agg(F.avg("o_totalprice").alias("primary_metric_mean"), F.lit("rmse").alias("primary_metric"))
    )


def evidence_refs(spark, sf):
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("bigint").cast("string")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.when(key % 5 == 0, "col:y:mean").otherwise("col:x:mean").alias("metric_key"),
        F.when(key % 10 == 0, price).otherwise(F.lit('"text"')).alias("claimed_value_json"),
    )


MODEL_SQL = f"""select r.run_id, dataset, arm, temperature, repeat, 'm' || (c_nationkey % 4) as selected_model,
  case when mean is not null then 'rmse' end as primary_metric, round(coalesce(mean, c_acctbal), 4) as primary_metric_value,
  base as positive_class_base_rate
from customer join {RUNS} r on c_custkey = r.run_id
left join (select o_custkey, 'm' || (o_orderkey % 5) as model, avg(o_totalprice) as mean from orders group by 1, 2) e
  on e.o_custkey = c_custkey and model = 'm' || (c_nationkey % 4)
left join (select o_custkey, cast(max(trunc(o_totalprice)) as double) as base from orders where o_orderkey % 10 = 0
  group by 1) b on b.o_custkey = c_custkey and dataset = 'BUILDING'
where c_custkey % 3 <> 1 and c_nationkey % 4 <> 0"""


def model_metrics(spark, sf):
    return gold.model_metrics(
        run_metrics(spark, sf), evaluations(spark, sf), evidence_refs(spark, sf), runs(spark, sf), "BUILDING"
    )


@query("gold_model_metrics", MODEL_SQL)
def gold_model_metrics(spark, sf):
    return rounded(model_metrics(spark, sf), 4)


@query(
    "base_rate_lift",
    f"""select run_id, selected_model, primary_metric, primary_metric_value, positive_class_base_rate,
  round(primary_metric_value - positive_class_base_rate, 4) as absolute_lift
from ({MODEL_SQL}) where dataset = 'BUILDING'""",
)
def base_rate_lift(spark, sf):
    return rounded(gold.base_rate_lift(model_metrics(spark, sf), "BUILDING"), 4)


@query(
    "expected_scores",
    f"""select dataset, decision_key, count(*) as run_count, count(*) filter (layer2_score = 0) as score_0_count,
  count(*) filter (layer2_score = 1) as score_1_count, count(*) filter (layer2_score = 2) as score_2_count,
  count(*) filter (layer2_score = 3) as score_3_count,
  coalesce(string_agg(layer2_score, ',' order by layer2_score), '') = '1,1,3,3' as matches_expected
from {ENRICHED} e join {RUNS} r on e.run_id = r.run_id
where dataset = 'BUILDING' and arm = 'ab' and decision_key = '1-URGENT|1|accept' group by 1, 2""",
)
def expected_scores(spark, sf):
    return gold.expected_scores(
        enriched(spark, sf), runs(spark, sf), "BUILDING", "ab", "1-URGENT|1|accept", [1, 1, 3, 3]
    )


@query("claims_enriched", f"select * from {ENRICHED}")
def claims_enriched(spark, sf):
    return enriched(spark, sf)


LINE_GRAIN = ["l_orderkey", "l_linenumber"]


@query(
    "dq_grain_checks",
    """with g as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2),
s as (select sum(n) as rows, count(*) as keys, count(*) filter (n > 1) as dups,
  coalesce(sum(n) filter (l_orderkey is null or l_linenumber is null), 0) as nulls from g)
select 'lineitem' as table_name, 'row_count' as check_type, 'INFO' as status, keys as observed,
  cast(rows as bigint) as expected, 'Silver rows after grain deduplication' as details from s
union all select 'lineitem', 'null_keys', case when nulls = 0 then 'PASS' else 'FAIL' end, cast(nulls as bigint), 0,
  'l_orderkey, l_linenumber' from s
union all select 'lineitem', 'duplicate_keys', case when dups = 0 then 'PASS' else 'FAIL' end, dups, 0,
  'l_orderkey, l_linenumber' from s
union all select 'lineitem', 'deduplicated_row_count', 'PASS', keys, keys, 'One row per declared table grain' from s""",
)
def dq_grain_checks(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINE_GRAIN)
    silver = quality.deduplicate(lines, LINE_GRAIN).agg(F.count("*").alias("silver_rows"))
    summary = quality.grain_summary(lines, LINE_GRAIN).join(F.broadcast(silver))
    return quality.grain_checks(summary, "lineitem", LINE_GRAIN, F.col("silver_rows"))


@query(
    "dq_dedup",
    """select * exclude (rn) from (select *, row_number() over (partition by l_orderkey, l_linenumber order by
  l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as rn
  from lineitem) where rn = 1""",
)
def dq_dedup(spark, sf):
    return quality.deduplicate(table(spark, sf, "lineitem"), LINE_GRAIN)


@query(
    "dq_orphans",
    """select l_orderkey as claim_id, count(*) as verdicts from lineitem where l_orderkey not in
  (select o_orderkey from orders where o_orderstatus = 'F') group by 1""",
)
def dq_orphans(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"))
    kept = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("claim_id"))
    return joins.orphans(lines, kept, ["claim_id"]).groupBy("claim_id").agg(F.count("*").alias("verdicts"))


@query(
    "dq_gate",
    """with e as (select distinct l_orderkey as k from lineitem where l_returnflag = 'A'),
s as (select o_orderkey as k from orders where o_orderstatus <> 'P')
select k as claim_id, 'layer2_missing_eligible' as rule from (select k from e except select k from s)
union all select k, 'layer2_ineligible_claim' from (select k from s except select k from e)""",
)
def dq_gate(spark, sf):
    eligible = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("claim_id"))
    scored = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("claim_id"))
    return joins.layer2_gate(eligible, scored, ["claim_id"])


@query(
    "dq_join_coverage",
    f"""select count(*) as claim_count, count(claim_layer1_code) as layer1_joined, count(layer2_score) as layer2_joined,
  count(*) filter (claim_layer1_code = 'EVIDENCE_ACCURATE' and layer2_score is null) as eligible_missing_layer2,
  count(*) filter (claim_layer1_code <> 'EVIDENCE_ACCURATE' and layer2_score is not null) as ineligible_with_layer2,
  count(*) filter (claim_layer1_code is null) as claims_without_code from {ENRICHED}""",
)
def dq_join_coverage(spark, sf):
    return quality.join_coverage(enriched(spark, sf))


@query(
    "dq_missing_artifacts",
    """select r.run_id, artifact from (select conv_id as run_id, case when min(conv_id) % 2 = 0 then 'ab' else 'c' end
  as arm from conversations group by 1) r
join (values ('ab', 'user'), ('ab', 'assistant'), ('c', 'user'), ('c', 'system')) q(arm, artifact) on r.arm = q.arm
where not exists (select 1 from conversations c where c.conv_id = r.run_id and c.role = artifact)""",
)
def dq_missing_artifacts(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("role").alias("artifact"))
    arm = F.when(F.col("run_id") % 2 == 0, "ab").otherwise("c")
    required = spark.createDataFrame(
        [("ab", "user"), ("ab", "assistant"), ("c", "user"), ("c", "system")], "arm string, artifact string"
    )
    return quality.missing_artifacts(turns.select("run_id").distinct().withColumn("arm", arm), required, turns)


@query(
    "dq_row_counts",
    """with m as (select 'documents' as table_name, max(doc_id) + 1 as manifest_row_count from documents
  union all select 'labels', max(doc_id) + 1 from labels),
a as (select 'documents' as table_name, count(*) as actual_row_count from documents
  union all select 'labels', count(*) from labels)
select m.table_name, manifest_row_count, actual_row_count,
  case when manifest_row_count = actual_row_count then 'PASS' else 'FAIL' end as status
from m left join a on m.table_name = a.table_name""",
)
def dq_row_counts(spark, sf):
    manifest, actual = None, None
    for name in ("documents", "labels"):
        rows = table(spark, sf, name).select("doc_id")
        label = F.lit(name).alias("table_name")
        m = rows.agg((F.max("doc_id") + 1).alias("manifest_row_count")).select(label, "manifest_row_count")
        a = rows.agg(F.count("*").alias("actual_row_count")).select(label, "actual_row_count")
        manifest = m if manifest is None else manifest.unionByName(m)
        actual = a if actual is None else actual.unionByName(a)
    return quality.row_count_check(manifest, actual)


@query(
    "dq_rebuild_compare",
    """with a as (select o_orderpriority as stage, count(*) as n from orders group by 1),
b as (select o_orderpriority as stage, count(*) as n from orders where o_orderkey <> 0 group by 1)
select coalesce(x.stage, y.stage) as stage, coalesce(x.n, y.n) as n, (x.stage is not null)::bigint as left_count,
  (y.stage is not null)::bigint as right_count
from a x full join b y on x.stage = y.stage and x.n = y.n where x.stage is null or y.stage is null""",
)
def dq_rebuild_compare(spark, sf):
    """Two computations of one summary, of which the second lacks an order."""
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stage"), "o_orderkey")

    def summary(frame):
        return frame.groupBy("stage").agg(F.count("*").alias("n"))

    return quality.frame_differences(summary(orders), summary(orders.where("o_orderkey <> 0")))
