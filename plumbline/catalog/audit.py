"""Audit queries. Claims are orders, citations are line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import query, table
from plumbline.functions.ranking import running_totals
from plumbline.plans import audit
from plumbline.profile.associations import balance_rows

CODE_SQL = """case l_returnflag when 'A' then 'EVIDENCE_ACCURATE' when 'N' then 'EVIDENCE_MISSTATED'
  else 'FABRICATED_EVIDENCE' end"""


def flag_code(flag="l_returnflag"):
    return (
        F.when(F.col(flag) == "A", audit.ACCURATE)
        .when(F.col(flag) == "N", audit.MISSTATED)
        .otherwise(audit.FABRICATED)
    )


def claims(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_orderpriority").alias("stage"),
    )


def citations(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), flag_code().alias("layer1_code"))


def audited_totals(spark, sf):
    """Claimed order totals against the sum of their lines."""
    evidence = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("metric_key"),
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderpriority").alias("stage"),
        *audit.value_columns("claimed", num=F.col("o_totalprice")),
    )
    truth = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("metric_key"))
        .agg(F.sum("l_extendedprice").alias("total"))
        .select("metric_key", *audit.value_columns("real", num=F.col("total")))
    )
    return audit.verdicts(audit.resolve(evidence, truth))


VERDICT_SQL = """select o_orderkey as claim_id, o_custkey as run_id, o_orderpriority as stage,
  case when t.l_orderkey is null then 'FABRICATED_EVIDENCE'
       when abs(o_totalprice - total) / (case when total = 0 then 1e-8 else abs(total) end) <= 0.01
       then 'EVIDENCE_ACCURATE' else 'EVIDENCE_MISSTATED' end as layer1_code
from orders left join (select l_orderkey, sum(l_extendedprice) as total from lineitem group by 1) t
  on o_orderkey = t.l_orderkey"""


@query("audit_order_totals", f"select claim_id, layer1_code from ({VERDICT_SQL})")
def audit_order_totals(spark, sf):
    return audited_totals(spark, sf).select("claim_id", "layer1_code")


@query(
    "audit_rollup",
    f"""select o_orderkey as claim_id, o_orderpriority as stage,
  coalesce(citations, 0) as citations, coalesce(accurate, 0) as accurate,
  coalesce(misstated, 0) as misstated, coalesce(fabricated, 0) as fabricated,
  case when fabricated > 0 then 'FABRICATED_EVIDENCE' when misstated > 0 then 'EVIDENCE_MISSTATED'
       else 'EVIDENCE_ACCURATE' end as claim_layer1_code
from orders left join (
  select l_orderkey, count(*) as citations,
    count(*) filter (code = 'EVIDENCE_ACCURATE') as accurate,
    count(*) filter (code = 'EVIDENCE_MISSTATED') as misstated,
    count(*) filter (code = 'FABRICATED_EVIDENCE') as fabricated
  from (select l_orderkey, {CODE_SQL} as code from lineitem) group by 1) on o_orderkey = l_orderkey""",
)
def audit_rollup(spark, sf):
    return audit.roll_up(claims(spark, sf), citations(spark, sf), ["claim_id"]).drop("run_id")


@query(
    "audit_rates_by_stage",
    f"""with per_claim as (
  select o_orderkey, o_orderpriority as stage, count(l_orderkey) as c,
    count(*) filter (l_returnflag = 'N') as m,
    count(*) filter (l_orderkey is not null and l_returnflag not in ('A', 'N')) as f
  from orders left join lineitem on o_orderkey = l_orderkey group by 1, 2)
select stage, cast(sum(c) as bigint) as total_citations, count(*) as total_claims,
  round(sum(f) / (sum(c) * 1.0e0), 9) as citation_fabrication_rate,
  round(sum(m) / (sum(c) * 1.0e0), 9) as citation_misstatement_rate,
  round(avg(case when f > 0 then 1e0 else 0e0 end), 9) as claim_fabrication_rate,
  round(avg(case when f = 0 and m > 0 then 1e0 else 0e0 end), 9) as claim_misstatement_rate
from per_claim group by stage""",
)
def audit_rates_by_stage(spark, sf):
    rolled = audit.roll_up(claims(spark, sf), citations(spark, sf), ["claim_id"])
    rates = audit.audit_rates(rolled, ["stage"])
    return rates.select(
        "stage",
        "total_citations",
        "total_claims",
        *[F.round(c, 9).alias(c) for c in rates.columns if c.endswith("_rate")],
    )


@query(
    "audit_invalid_keys",
    """select distinct 'order:' || l_orderkey as metric_key from lineitem
where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')""",
)
def audit_invalid_keys(spark, sf):
    key = F.concat(F.lit("order:"), F.col("l_orderkey").cast("string"))
    profile_key = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    evidence = table(spark, sf, "lineitem").select(key.alias("metric_key"))
    profile = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(profile_key.alias("metric_key"))
    return audit.invalid_keys(evidence, profile)


@query(
    "audit_context",
    """with profile as (select 'flag:' || l_returnflag as k, cast(round(avg(l_extendedprice)) as bigint) as v
  from lineitem group by 1),
cited as (select distinct l_orderkey as claim_id, 'flag:' || l_returnflag as k from lineitem)
select claim_id, string_agg(cited.k || '=' || v, ',' order by cited.k) as context
from cited join profile on cited.k = profile.k group by 1""",
)
def audit_context(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("metric_key", F.concat(F.lit("flag:"), "l_returnflag"))
    profile = lines.groupBy("metric_key").agg(F.round(F.avg("l_extendedprice")).cast("bigint").alias("value"))
    evidence = lines.select(F.col("l_orderkey").alias("claim_id"), "metric_key")
    context = audit.claim_context(evidence, profile, ["claim_id"])
    entry = F.transform(
        F.map_entries("context"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return context.select("claim_id", F.array_join(entry, ",").alias("context"))


@query(
    "audit_map_evidence",
    """with real_n as (select l_suppkey, l_returnflag as f, count(*) as n from lineitem group by 1, 2),
claim_n as (select l_suppkey, l_returnflag as f, count(*) as n from lineitem where l_linenumber <= 6 group by 1, 2),
r as (select l_suppkey, f, n / (sum(n) over (partition by l_suppkey) * 1e0) as s from real_n),
c as (select l_suppkey, f, n / (sum(n) over (partition by l_suppkey) * 1e0) as s from claim_n),
j as (select coalesce(r.l_suppkey, c.l_suppkey) as k, coalesce(r.f, c.f) as f,
  coalesce(abs(c.s - r.s) / r.s <= 0.01, false) as ok from r full join c on r.l_suppkey = c.l_suppkey and r.f = c.f)
select k as entity,
  case when not exists (select 1 from c where c.l_suppkey = k) then 'EVIDENCE_MISSTATED'
    when bool_and(ok) then 'EVIDENCE_ACCURATE' else 'EVIDENCE_MISSTATED' end as map_code,
  case when count(*) filter (f = 'A' and exists (select 1 from r where r.l_suppkey = k and r.f = 'A')) = 0
    then 'FABRICATED_EVIDENCE'
    when bool_or(f = 'A' and ok) then 'EVIDENCE_ACCURATE' else 'EVIDENCE_MISSTATED' end as subkey_code
from j group by k""",
)
def audit_map_evidence(spark, sf):
    """Flag balance of a supplier: a claimed map, and one claimed entry cited as ``balance[A]``."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linenumber")

    def balance(frame):
        counts = frame.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
        grouped = counts.groupBy("l_suppkey").agg(
            F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m")
        )
        return grouped.select(
            F.col("l_suppkey").alias("entity"),
            F.transform_values("m", lambda _, n: n / F.col("total")).alias("shares"),
        )

    profile = balance(lines).select(
        "entity", F.lit("balance").alias("metric_key"), *audit.value_columns("real", map=F.col("shares"))
    )
    stated = balance(lines.where("l_linenumber <= 6"))
    whole = stated.select(
        "entity", F.lit("balance").alias("metric_key"), *audit.value_columns("claimed", map=F.col("shares"))
    )
    single = stated.select(
        "entity",
        F.lit("balance[A]").alias("metric_key"),
        *audit.value_columns("claimed", num=F.col("shares")["A"]),
    )
    judged = audit.verdicts(
        audit.resolve_with_subkeys(whole.unionByName(single), profile, ["entity", "metric_key"])
    )
    return judged.groupBy("entity").agg(
        F.max(F.when(F.col("metric_key") == "balance", F.col("layer1_code"))).alias("map_code"),
        F.max(F.when(F.col("metric_key") == "balance[A]", F.col("layer1_code"))).alias("subkey_code"),
    )


@query(
    "audit_map_rows",
    """with n as (select l_returnflag as f, l_orderkey as k, count(*) as n, count(*) filter (l_linenumber <= 6) as m
  from lineitem group by 1, 2),
r as (select f, k, n / (sum(n) over (partition by f) * 1e0) as s from n where f <> 'R'),
t as (select f, k, m / (sum(m) over (partition by f) * 1e0) as s from n where f = 'N' and m > 0),
c as (select f, k, s * 1.005e0 as s from r where f = 'A' union all select * from t
  union all select f, k, 1e0 from n where f = 'R'),
j as (select coalesce(c.f, r.f) as entity, c.k as ck, r.k as rk, coalesce(abs(c.s - r.s) / r.s <= 0.01, false) as ok
  from c full join r on c.f = r.f and c.k = r.k)
select entity, count(ck) as claimed_entries, count(rk) as real_entries, count(*) filter (ok) as matched_entries,
  case when count(rk) = 0 then 'FABRICATED_EVIDENCE' when bool_and(ok) then 'EVIDENCE_ACCURATE' else 'EVIDENCE_MISSTATED' end
  as layer1_code from j group by 1""",
)
def audit_map_rows(spark, sf):
    """Balance of orders within a return flag, a class for each order: nearly right, from fewer lines, and invented."""
    lines = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("entity"), "l_orderkey", "l_linenumber")

    def balance(frame):
        counts = frame.groupBy("entity", F.col("l_orderkey").alias("value")).agg(F.count("*").alias("n"))
        return balance_rows(counts, digits=None)

    known, invented = balance(lines.where("entity <> 'R'")), balance(lines.where("entity = 'R'"))
    claimed = (
        known.where("entity = 'A'").withColumn("value", F.col("value") * 1.005)
        .unionByName(balance(lines.where("entity = 'N' and l_linenumber <= 6")))
        .unionByName(invented.withColumn("value", F.lit(1.0)))
    )
    return audit.map_verdicts(claimed, known, ["entity"])


def flagged_evidence(spark, sf):
    key = (
        F.when(F.col("l_returnflag") == "R", "col:x:leakage_suspect")
        .when(F.col("l_returnflag") == "A", "col:x:is_skewed")
        .otherwise("col:x:is_id_like")
    )
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"),
        key.alias("metric_key"),
        (F.col("l_linenumber") % 2 == 1).alias("claimed_bool"),
    )


def severity_claims(spark, sf):
    stated = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
        .when(F.col("o_orderpriority") == "2-HIGH", "warn")
        .otherwise("info")
    )
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("claim_id"),
        stated.alias("llm_stated_severity"),
    )


SEVERITY_SQL = """select o_custkey as run_id, o_orderkey as claim_id,
  case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'warn' else 'info' end as stated,
  case when bool_or(l_returnflag = 'R' and l_linenumber % 2 = 1) then 'critical'
       when bool_or(l_returnflag = 'A' and l_linenumber % 2 = 1) then 'warn' else 'info' end as severity
from orders left join lineitem on o_orderkey = l_orderkey group by 1, 2, o_orderpriority"""


@query(
    "severity_rules",
    f"select claim_id, severity, stated <> severity as severity_rule_violation from ({SEVERITY_SQL})",
)
def severity_rules(spark, sf):
    derived = audit.derived_severity(severity_claims(spark, sf), flagged_evidence(spark, sf), ["claim_id"])
    return audit.annotate_severity(derived).select("claim_id", "severity", "severity_rule_violation")


@query(
    "severity_violation",
    f"""select run_id, count(*) as claims, round(avg((stated <> severity)::int), 9) as severity_violation_rate
from ({SEVERITY_SQL}) group by 1""",
)
def severity_violation(spark, sf):
    derived = audit.derived_severity(severity_claims(spark, sf), flagged_evidence(spark, sf), ["claim_id"])
    return (
        audit.annotate_severity(derived)
        .groupBy("run_id")
        .agg(
            F.count("*").alias("claims"),
            F.round(F.avg(F.col("severity_rule_violation").cast("double")), 9).alias("severity_violation_rate"),
        )
    )


@query(
    "severity_recompute",
    f"""select run_id, round(avg((stated = 'critical')::int), 9) as stored_rate,
  round(avg((stated <> severity)::int), 9) as corrected_rate,
  round(avg((stated <> severity)::int) - avg((stated = 'critical')::int), 9) as delta
from ({SEVERITY_SQL}) group by 1""",
)
def severity_recompute(spark, sf):
    """Stored violation flags against flags derived again under the current rule."""
    derived = audit.derived_severity(severity_claims(spark, sf), flagged_evidence(spark, sf), ["claim_id"])
    stored = F.avg((F.col("llm_stated_severity") == "critical").cast("double"))
    corrected = F.avg(F.col("severity_rule_violation").cast("double"))
    return (
        audit.annotate_severity(derived)
        .groupBy("run_id")
        .agg(
            F.round(stored, 9).alias("stored_rate"),
            F.round(corrected, 9).alias("corrected_rate"),
            F.round(corrected - stored, 9).alias("delta"),
        )
    )


@query(
    "audit_eligible",
    f"""select o_orderkey as claim_id from orders where o_orderkey not in (
  select l_orderkey from lineitem where {CODE_SQL} <> 'EVIDENCE_ACCURATE')""",
)
def audit_eligible(spark, sf):
    rolled = audit.roll_up(claims(spark, sf), citations(spark, sf), ["claim_id"])
    return audit.eligible(rolled).select("claim_id")


@query(
    "audit_code_chunks",
    f"""with n as (select l_suppkey as claim_id, l_linenumber || {CODE_SQL} as code, row_number() over (partition by l_suppkey
  order by l_orderkey, l_linenumber, l_partkey, {CODE_SQL}) - 1 as i from lineitem)
select claim_id, (i // 16)::bigint as chunk, string_agg(code, ',' order by i) as codes from n group by 1, 2""",
)
def audit_code_chunks(spark, sf):
    """Codes of all citations of a supplier in citation order, in bounded arrays; equal ones are counted, then numbered."""
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", flag_code().alias("code")).alias("place")
    counted = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("claim_id"), place).agg(F.count("*").alias("n"))
    placed = running_totals(counted, ["claim_id"], "place", ["n"])
    numbered = placed.select(
        "claim_id",
        F.explode(F.sequence(F.col("cum_n") - F.col("n"), F.col("cum_n") - 1)).alias("evidence_index"),
        F.concat(F.col("place.l_linenumber").cast("string"), "place.code").alias("layer1_code"),
    )
    chunks = audit.citation_code_chunks(numbered, ["claim_id"], chunk=16)
    return chunks.select("claim_id", "chunk", F.array_join("citation_layer1_codes", ",").alias("codes"))


@query(
    "audit_notes",
    """select doc_id, case when doc_id % 4 = 3 then '' else substr(text, 1, 300) end as note from documents""",
)
def audit_notes(spark, sf):
    note = audit.critic_note(F.col("doc_id") % 4, F.col("text"))
    return table(spark, sf, "documents").select("doc_id", note.alias("note"))


@query(
    "rescore_diff",
    """select o_orderkey as claim_id, o_orderstatus as justification,
  case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as new_justification,
  o_orderkey % 4 as layer2_score, case when o_orderkey % 11 = 0 then 3 else o_orderkey % 4 end as new_layer2_score,
  o_orderkey % 13 = 0 as unexpected_change
from orders where o_orderkey % 7 = 0 or (o_orderkey % 11 = 0 and o_orderkey % 4 <> 3) or o_orderkey % 13 = 0""",
)
def rescore_diff(spark, sf):
    before = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_orderstatus").alias("justification"),
        (F.col("o_orderkey") % 4).alias("layer2_score"),
        F.col("o_orderpriority").alias("stage"),
    )
    key = F.col("claim_id")
    after = (
        before.withColumn("justification", F.when(key % 7 == 0, "X").otherwise(F.col("justification")))
        .withColumn("layer2_score", F.when(key % 11 == 0, 3).otherwise(F.col("layer2_score")).cast("bigint"))
        .withColumn("stage", F.when(key % 13 == 0, "moved").otherwise(F.col("stage")))
    )
    changes = audit.rescore_changes(before, after, ["claim_id"], ["justification", "layer2_score"])
    return changes.drop("stage", "new_stage")


@query(
    "layer2_by_stage",
    """select o_orderpriority as stage, count(s) as layer2_claims_scored, round(avg(s), 9) as mean_layer2_score,
  round(avg(case when s is not null then (s = 0)::int end), 9) as mischaracterization_rate,
  round(avg(case when s is not null then (s = 1)::int end), 9) as wrong_direction_rate
from (select *, case when o_orderstatus <> 'P' and o_orderpriority <> '5-LOW' then o_orderkey % 4 end as s from orders)
group by 1""",
)
def layer2_by_stage(spark, sf):
    orders = table(spark, sf, "orders")
    scores = orders.where("o_orderstatus <> 'P' and o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("claim_id"), (F.col("o_orderkey") % 4).alias("layer2_score")
    )
    metrics = audit.layer2_metrics(claims(spark, sf), scores, ["stage"], ["claim_id"])
    rounded = ("mean_layer2_score", "mischaracterization_rate", "wrong_direction_rate")
    return metrics.select("stage", "layer2_claims_scored", *[F.round(c, 9).alias(c) for c in rounded])
