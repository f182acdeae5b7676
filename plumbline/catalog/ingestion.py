"""Ingestion queries.

Artifact lines are made from the given tables as JSON text, then read the way run files are: parsed,
keyed, checked and typed. Files themselves are covered by the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import query, table
from plumbline.plans import normalize as nz
from plumbline.profile.univariate import union_all
from plumbline.session import shared_dir
from plumbline.sinks import backfill as bf
from plumbline.sources import delimited, secrets
from plumbline.sources import runs as run_source


def claim_lines(spark, sf):
    """One claims file per customer; every 17th line is broken, every 19th is no object."""
    key = F.col("o_orderkey")
    which = key % 4
    number = F.round(F.col("o_totalprice") / 1000.0).cast("bigint").cast("string")
    evidence = F.format_string(
        '[{"metric_key":"col:c%d:%s","claimed_value":%s},{"metric_key":"target:x","claimed_value":%s},7]',
        key % 10,
        F.when(key % 3 == 0, "is_skewed").when(key % 3 == 1, "leakage_suspect").otherwise("mean"),
        F.when(key % 5 == 0, "false").when(key % 5 == 1, "2.5").otherwise("true"),
        F.when(key % 6 == 0, "null").when(key % 6 == 1, F.concat(F.lit('{"b":[1.0,2,"z"],"a":'), number, F.lit("}"))).otherwise(
            F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"'))
        ),
    )
    body = F.concat(
        F.format_string('{"claim_id":"k%d","confidence":0.5,"extra":[1],', key),
        F.when(which == 0, F.concat(F.lit('"stage":"eda","evidence":'), evidence))
        .when(which == 1, F.concat(
            F.format_string('"stage":"preprocess","column":"c%d","action":"', key % 10),
            F.when(key % 3 == 0, "drop").when(key % 3 == 1, "impute_and_scale").otherwise("impute"),
            F.lit('","imputation":"mean","scaling":"robust","encoding":"none"')))
        .when(which == 2, F.concat(
            F.format_string('"stage":"model_selection","model_id":"m%d","is_rejection":', key % 3),
            F.when(key % 5 == 0, "true").when(key % 5 == 1, '"no"').otherwise("false")))
        .otherwise(F.lit('"stage":"evaluation","primary_metric":"roc_auc","secondary_metrics":["f1"]')),
        F.lit("}"),
    )
    text = F.when(key % 17 == 3, F.lit('{"claim_id":')).when(key % 19 == 4, F.lit("[1,2]")).when(
        key % 23 == 5, F.lit("  ")
    ).otherwise(body)
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.lit("claims.jsonl").alias("artifact"),
        (key + 1).alias("line_no"),
        text.alias("value"),
        F.concat(F.lit("d"), (F.col("o_custkey") % 7).cast("string")).alias("dataset"),
    )


BROKEN = "(o_orderkey % 17 = 3)"
NO_OBJECT = f"(not {BROKEN} and o_orderkey % 19 = 4)"
BLANK = f"(not {BROKEN} and o_orderkey % 19 <> 4 and o_orderkey % 23 = 5)"
GOOD = f"(not {BROKEN} and o_orderkey % 19 <> 4 and o_orderkey % 23 <> 5)"

KEYED_SQL = f"""(select o_custkey as run_id, 'k' || o_orderkey as claim_id, o_orderkey as k,
  case o_orderkey % 4 when 0 then 'eda' when 1 then 'preprocess' when 2 then 'model_selection' else 'evaluation' end as stage,
  case o_orderkey % 4 when 0 then case when flag is not null then 'column' end when 1 then 'column' when 2 then 'model'
    else 'metric' end as subject_type,
  case o_orderkey % 4 when 0 then case when flag is not null then 'c' || (o_orderkey % 10) end
    when 1 then 'c' || (o_orderkey % 10) when 2 then 'm' || (o_orderkey % 3) else 'roc_auc' end as subject,
  case o_orderkey % 4 when 0 then flag
    when 1 then case o_orderkey % 3 when 0 then 'drop' when 1 then 'impute_mean+scale_robust' end
    when 2 then case when o_orderkey % 5 = 0 then 'reject' when o_orderkey % 5 <> 1 then 'accept' end
    else 'select' end as decision
from (select *, case when o_orderkey % 5 not in (0, 1) then case o_orderkey % 3 when 0 then 'flag_skew'
  when 1 then 'flag_leakage' end end as flag from orders where {GOOD}))"""


@query(
    "ingest_claims",
    f"""select run_id, claim_id, stage, subject_type, subject, decision, stage || '|' || subject || '|' || decision
  as decision_key from {KEYED_SQL}""",
)
def ingest_claims(spark, sf):
    parsed, _ = nz.parse_lines(claim_lines(spark, sf))
    return nz.claims_with_keys(parsed).select(
        "run_id", "claim_id", "stage", "subject_type", "subject", "decision", "decision_key"
    )


@query(
    "ingest_malformed",
    f"""select o_custkey as run_id, 'malformed_json' as rule, 'error' as severity, 'claims.jsonl' as artifact,
  'line:' || (o_orderkey + 1) as record_key, case when {BROKEN} then 'Could not parse JSON on line ' || (o_orderkey + 1)
    else 'JSON line ' || (o_orderkey + 1) || ' is not an object' end as message, '{{}}' as details_json
from orders where {BROKEN} or {NO_OBJECT}""",
)
def ingest_malformed(spark, sf):
    return nz.parse_lines(claim_lines(spark, sf))[1]


@query(
    "ingest_unkeyable",
    f"""select run_id, 'unkeyable_claim' as rule, claim_id as record_key from {KEYED_SQL}
where subject is null or decision is null""",
)
def ingest_unkeyable(spark, sf):
    parsed, _ = nz.parse_lines(claim_lines(spark, sf))
    return nz.unkeyable(nz.claims_with_keys(parsed)).select("run_id", "rule", "record_key")


@query(
    "ingest_evidence",
    f"""with e as (select * from orders where {GOOD} and o_orderkey % 4 = 0)
select o_custkey as run_id, 'k' || o_orderkey as claim_id, 0::bigint as evidence_index, 'col:c' || (o_orderkey % 10) || ':' ||
  case o_orderkey % 3 when 0 then 'is_skewed' when 1 then 'leakage_suspect' else 'mean' end as metric_key,
  case when o_orderkey % 5 = 1 then 'float' else 'bool' end as claimed_value_type,
  case o_orderkey % 5 when 0 then 'false' when 1 then '2.5' else 'true' end as claimed_value_json from e
union all select o_custkey, 'k' || o_orderkey, 1, 'target:x', case o_orderkey % 6 when 0 then 'null' when 1 then 'object'
  else 'str' end, case o_orderkey % 6 when 0 then 'null' when 1 then '{{"a":' || cast(round(o_totalprice / 1000) as bigint)
  || ',"b":[1.0,2,"z"]}}' else '"' || o_orderstatus || '"' end from e""",
)
def ingest_evidence(spark, sf):
    parsed, _ = nz.parse_lines(claim_lines(spark, sf))
    return nz.evidence_refs(nz.claims_with_keys(parsed))


@query(
    "call_flatten",
    """select event_id, user_id as run_id, row_number() over (partition by user_id order by event_id) - 1 as call_index,
  event_type as stage, cast(json_extract_string(props, '$.k') as bigint) as input_tokens,
  'model' || (user_id % 3) as prompt_model, '{"k":' || json_extract_string(props, '$.k') || '}' as error_json from events""",
)
def call_flatten(spark, sf):
    """Event properties as call records, one file per user in event order."""
    event = table(spark, sf, "events")
    value = F.concat(
        F.lit('{"stage":"'), "event_type", F.lit('","tokens":{"output":1,"input":'),
        F.get_json_object("props", "$.k"), F.lit('},"error":'), "props",
        F.lit(',"prompt":{"model":"model'), (F.col("user_id") % 3).cast("string"), F.lit('"}}'),
    )
    lines = event.select(
        F.col("user_id").alias("run_id"),
        F.lit("prompts.jsonl").alias("artifact"),
        F.col("event_id").alias("line_no"),
        value.alias("value"),
    )
    parsed, _ = nz.parse_lines(lines)
    calls = nz.prompt_calls(parsed)
    ids = run_source.position(event.select("user_id", "event_id"), "user_id", "event_id", "call_index")
    named = ids.select(F.col("user_id").alias("run_id"), "event_id", "call_index")
    return calls.join(named, ["run_id", "call_index"]).select(
        "event_id", "run_id", "call_index", "stage", "input_tokens", "prompt_model", "error_json"
    )


@query("json_fields", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_fields(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("props").alias("value"))
    return nz.fields(rows, "k bigint", "event_id")


@query(
    "metric_unpivot",
    """with e as (select l_suppkey as run_id, 'm' || (l_linenumber % 3) as model_id, round(avg(l_extendedprice)) as p,
  round(avg(l_quantity) * 100) as q, round(avg(l_tax) * 10000) as t from lineitem group by 1, 2)
select run_id, model_id, 'primary' as metric_role, 'rmse' as metric_name, p as mean, 1e0 as std from e
union all select run_id, model_id, 'secondary', 'mae', q, 2e0 from e
union all select run_id, model_id, 'secondary', 'r2', t, null from e""",
)
def metric_unpivot(spark, sf):
    measured = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("run_id"), F.concat(F.lit("m"), (F.col("l_linenumber") % 3).cast("string")).alias("model_id")
    ).agg(
        F.round(F.avg("l_extendedprice")).alias("p"),
        F.round(F.avg("l_quantity") * 100).alias("q"),
        F.round(F.avg("l_tax") * 10000).alias("t"),
    )
    value = F.format_string(
        '{"model_id":"%s","primary_metric":"rmse","primary_metric_mean":%s,"primary_metric_std":1.0,'
        '"secondary_metrics":{"mae":{"mean":%s,"std":2.0},"r2":{"mean":%s}}}',
        "model_id", F.col("p").cast("string"), F.col("q").cast("string"), F.col("t").cast("string"),
    )
    return nz.evaluation_metrics(measured.select("run_id", value.alias("value")))


@query(
    "call_models_by_run",
    """select conv_id as run_id,
  coalesce(string_agg(distinct 'm-' || role, ',' order by 'm-' || role) filter (turn % 3 <> 0), '') as agent_model,
  coalesce(string_agg(distinct 'm-' || role, ',' order by 'm-' || role) filter (turn % 3 = 0), '') as critic_model
from conversations group by 1""",
)
def call_models_by_run(spark, sf):
    calls = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"),
        F.when(F.col("turn") % 3 == 0, "critic_eda").otherwise("eda").alias("stage"),
        F.concat(F.lit("m-"), "role").alias("prompt_model"),
    )
    return bf.call_models(calls)


@query(
    "text_line_explode",
    """select doc_id, count(*) as lines, cast(sum(length(line)) as bigint) as characters,
  count(*) filter (trim(line, ' ') = '') as blank_lines
from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by 1""",
)
def text_line_explode(spark, sf):
    lines = secrets.split_lines(table(spark, sf, "documents"), "doc_id", "text")
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"),
        F.sum(F.length("value")).alias("characters"),
        F.count_if(F.trim("value") == "").alias("blank_lines"),
    )


PLANTED = """(select doc_id, replace(text, 'token = ', 'access_token = ') || case doc_id % 9 when 0 then
  chr(10) || 'AKIA' || upper(substr(md5(cast(doc_id as varchar)), 1, 16)) when 1 then
  chr(10) || 'use BEARER ' || md5(cast(doc_id as varchar)) when 2 then chr(10) || 'sk-ant-' || md5(cast(doc_id as varchar))
  when 3 then chr(10) || 'akia' || md5(cast(doc_id as varchar)) when 4 then chr(10) || 'ghp_' ||
  md5(cast(doc_id as varchar)) || ' xoxb-' || md5(cast(doc_id as varchar)) else '' end as text from documents)"""


def secret_sql(source, key, text):
    """Every line of a text column against every pattern."""
    rows = []
    for name, regex in secrets.PATTERNS:
        insensitive = regex.startswith("(?i)")
        plain = regex.removeprefix("(?i)").replace("'", "''")
        option = ", 'i'" if insensitive else ""
        rows.append(
            f"select k, line_no, '{name}' as pattern from l where regexp_matches(line, '{plain}'{option})"
        )
    return f"""with l as (select {key} as k, unnest(string_split({text}, chr(10))) as line,
  generate_subscripts(string_split({text}, chr(10)), 1) as line_no from {source}) {' union all '.join(rows)}"""


def scan(spark, sf, name, key, text):
    lines = secrets.split_lines(table(spark, sf, name), key, text)
    return secrets.scan_lines(lines, [key, "line_no"]).withColumnRenamed(key, "k")


@query("secret_scan", secret_sql("documents", "doc_id", "text"))
def secret_scan(spark, sf):
    return scan(spark, sf, "documents", "doc_id", "text")


@query("secret_scan_planted", secret_sql(PLANTED, "doc_id", "text"))
def secret_scan_planted(spark, sf):
    """Documents with tokens of several kinds added by document number."""
    digest, kind = F.md5(F.col("doc_id").cast("string")), F.col("doc_id") % 9
    extra = (
        F.when(kind == 0, F.concat(F.lit("\nAKIA"), F.upper(F.substring(digest, 1, 16))))
        .when(kind == 1, F.concat(F.lit("\nuse BEARER "), digest))
        .when(kind == 2, F.concat(F.lit("\nsk-ant-"), digest))
        .when(kind == 3, F.concat(F.lit("\nakia"), digest))
        .when(kind == 4, F.concat(F.lit("\nghp_"), digest, F.lit(" xoxb-"), digest))
        .otherwise("")
    )
    text = F.concat(F.replace(F.col("text"), F.lit("token = "), F.lit("access_token = ")), extra)
    documents = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    lines = secrets.split_lines(documents, "doc_id", "text")
    return secrets.scan_lines(lines, ["doc_id", "line_no"]).withColumnRenamed("doc_id", "k")


@query("secret_scan_pages", secret_sql("pages", "page_id", "html"))
def secret_scan_pages(spark, sf):
    return scan(spark, sf, "pages", "page_id", "html")


@query(
    "secret_scan_conversations",
    f"""select k as conv_id, pattern, count(*) as lines from ({secret_sql("conversations", "conv_id", "text")}) group by 1, 2""",
)
def secret_scan_conversations(spark, sf):
    hits = scan(spark, sf, "conversations", "conv_id", "text")
    return hits.groupBy(F.col("k").alias("conv_id"), "pattern").agg(F.count("*").alias("lines"))


@query(
    "numeric_looking_strings",
    " union all ".join(
        f"""select '{c}' as column_name, round(avg((try_cast(v as double) is not null)::int), 9) as numeric_share,
  avg((try_cast(v as double) is not null)::int) > 0.98 as numeric_looking from (select {e} as v from customer)"""
        for c, e in (
            ("code", "cast(c_custkey as varchar)"),
            ("mixed", "case when c_custkey % 10 = 0 then c_name else cast(c_acctbal as varchar) end"),
            ("segment", "c_mktsegment"),
        )
    ),
)
def numeric_looking_strings(spark, sf):
    name = F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")).otherwise(F.col("c_acctbal").cast("string"))
    frame = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("code"), name.alias("mixed"), F.col("c_mktsegment").alias("segment")
    )
    return delimited.numeric_looking(frame).withColumn("numeric_share", F.round("numeric_share", 9))


@query(
    "preflight_issues",
    """select 'o_orderpriority' as column_name, 'regression target is non-numeric' as issue
union all select 'o_orderpriority', 'target has ' || count(*) || ' missing values' from orders
  where o_orderpriority = '3-MEDIUM' having count(*) > 0
union all select 'key_text', 'numeric-looking text'""",
)
def preflight_issues(spark, sf):
    frame = table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("o_orderpriority"),
        F.col("o_orderkey").cast("string").alias("key_text"),
        "o_totalprice",
    )
    return delimited.preflight(frame, "o_orderpriority", "regression")


@query(
    "csv_round_trip",
    """select p_partkey, trim(p_name) as p_name, case when p_size % 9 <> 0 then p_size end as p_size, p_retailprice from part""",
)
def csv_round_trip(spark, sf):
    """Parts written with ``;`` and ``?`` for missing sizes, read back with a schema and trimmed."""
    path = shared_dir(spark, "parts")
    size = F.when(F.col("p_size") % 9 != 0, F.col("p_size"))
    parts = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("  "), "p_name").alias("p_name"), size.alias("p_size"), "p_retailprice"
    )
    parts.write.option("sep", ";").option("header", "true").option("nullValue", "?").option(
        "ignoreLeadingWhiteSpace", "false"
    ).csv(path)
    return delimited.read_csv(
        spark, path, "p_partkey bigint, p_name string, p_size int, p_retailprice double", sep=";", null_value="?", trim=True
    )


@query(
    "coerce_numeric",
    """select c_custkey, case when c_custkey % 10 <> 0 then c_acctbal end as balance from customer""",
)
def coerce_numeric(spark, sf):
    text = F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")).otherwise(F.col("c_acctbal").cast("string"))
    frame = table(spark, sf, "customer").select("c_custkey", text.alias("balance"))
    return delimited.coerce_numeric(frame, ["balance", "absent"])


@query(
    "run_identity",
    """with n as (select 'm9_' || lower(c_mktsegment) || case when c_nationkey % 3 = 0 then '_ab_t0' else '_c_t0' end ||
  case when c_nationkey % 2 = 0 then '0' when c_nationkey % 5 = 1 then '7' else '9' end || '_r' || c_custkey
  as run_id, * from customer)
select run_id, case when ok then lower(c_mktsegment) end as dataset, case when ok then case when c_nationkey % 3 = 0 then 'ab'
  else 'c' end end as arm, case when ok then case when c_nationkey % 2 = 0 then 't00' else 't07' end end as temperature_code,
  case when ok then case when c_nationkey % 2 = 0 then 0.0e0 else 0.7e0 end end as temperature,
  case when ok then c_custkey end as repeat from (select *, c_nationkey % 2 = 0 or c_nationkey % 5 = 1 as ok from n)""",
)
def run_identity(spark, sf):
    n = F.col("c_nationkey")
    name = F.concat(
        F.lit("m9_"), F.lower("c_mktsegment"), F.when(n % 3 == 0, "_ab_t0").otherwise("_c_t0"),
        F.when(n % 2 == 0, "0").when(n % 5 == 1, "7").otherwise("9"), F.lit("_r"), F.col("c_custkey").cast("string"),
    )
    named = table(spark, sf, "customer").select(name.alias("run_id"))
    return named.select("run_id", *run_source.run_identity(F.col("run_id")))


def summary_inputs(spark, sf):
    from plumbline.catalog import gold

    calls = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "critic_x").otherwise("x").alias("stage"),
        F.col("o_orderstatus").alias("prompt_model"),
    )
    runs = gold.runs(spark, sf).select("run_id", "dataset", "arm", "temperature", "repeat")
    return bf.run_summaries(
        runs, gold.run_metrics(spark, sf), calls, gold.evidence(spark, sf), gold.layer2(spark, sf), gold.defects(spark, sf)
    )


SUMMARY_SQL = """(select c_custkey as run_id, c_mktsegment as dataset, case when c_nationkey % 5 = 0 then 'c' else 'ab' end as arm,
  case when c_nationkey % 2 = 0 then 0.0e0 else 0.7e0 end as temperature, c_custkey % 3 + 1 as repeat,
  case when c_custkey % 3 <> 1 and c_nationkey % 4 <> 0 then c_acctbal end as primary_model_metric,
  case when c_custkey % 3 <> 1 and c_nationkey % 4 <> 0 then c_nationkey / 100e0 end as override_rate,
  agent_model, critic_model, round(acc, 9) as layer1_accuracy_rate, round(s, 9) as mean_layer2_score,
  round(rec, 9) as arm_c_recall
from customer
left join (select o_custkey, coalesce(string_agg(distinct o_orderstatus, ',' order by o_orderstatus)
    filter (o_orderkey % 3 <> 0), '') as agent_model,
    coalesce(string_agg(distinct o_orderstatus, ',' order by o_orderstatus) filter (o_orderkey % 3 = 0), '') as critic_model,
    avg(case when o_orderstatus <> 'P' then o_orderkey % 4 end) as s from orders group by 1) o on o.o_custkey = c_custkey
left join (select o_custkey, avg((l_returnflag = 'A')::int) as acc,
    avg(case l_returnflag when 'A' then 1e0 when 'R' then 0e0 end) as rec
    from lineitem join orders on l_orderkey = o_orderkey group by 1) l on l.o_custkey = c_custkey)"""


def rounded(frame):
    rates = ("layer1_accuracy_rate", "mean_layer2_score", "arm_c_recall")
    return frame.withColumns({c: F.round(c, 9) for c in rates})


@query("run_summaries", f"select * from {SUMMARY_SQL}")
def run_summaries(spark, sf):
    return rounded(summary_inputs(spark, sf))


@query(
    "run_backfill_new",
    f"""select *, case when run_id % 4 = 0 then 'skipped' else 'created' end as status from {SUMMARY_SQL}""",
)
def run_backfill_new(spark, sf):
    known = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("run_id"))
    return rounded(bf.backfill_status(summary_inputs(spark, sf), known))


@query(
    "run_bundle_json",
    """select o_custkey as run_id, 'claims' as artifact, cast(o_orderkey as varchar) as record_key, '{"claim_id":' || o_orderkey
  || ',"run_id":' || o_custkey || ',"stage":"' || o_orderpriority || '"}' as record from orders
union all select o_custkey, 'layer2_verdicts', cast(o_orderkey as varchar), '{"claim_id":' || o_orderkey
  || ',"layer2_score":' || coalesce(cast(case when o_orderstatus <> 'P' then o_orderkey % 4 end as varchar), 'null')
  || ',"run_id":' || o_custkey || '}' from orders""",
)
def run_bundle_json(spark, sf):
    orders = table(spark, sf, "orders")
    keys = [F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("claim_id")]
    claims = orders.select(*keys, F.col("o_orderpriority").alias("stage"))
    scores = orders.select(
        *keys, F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 4).alias("layer2_score")
    )
    order = ["run_id", "claim_id"]
    return bf.bundle_records({"claims": (claims, order), "layer2_verdicts": (scores, order)})


@query(
    "dq_rules",
    f"""with bad as (select o_custkey as run_id, 'malformed_json' as rule, 'line:' || (o_orderkey + 1) as record_key
  from orders where {BROKEN} or {NO_OBJECT}),
k as (select * from {KEYED_SQL}),
v as (select o_custkey as run_id, 'k' || o_orderkey as claim_id, o_orderstatus = 'F' as ok, o_orderkey from orders),
orphan as (select run_id, 'orphan_claim_id', claim_id from v where claim_id not in (select claim_id from k)),
missing as (select run_id, 'layer2_missing_eligible', claim_id from v where ok and o_orderkey % 2 <> 0
  and claim_id in (select claim_id from k)),
extra as (select run_id, 'layer2_ineligible_claim', claim_id from v where o_orderkey % 2 = 0
  and (not ok or claim_id not in (select claim_id from k)))
select * from bad union all select * from orphan union all select * from missing union all select * from extra
union all select run_id, 'unkeyable_claim', claim_id from k where subject is null or decision is null""",
)
def dq_rules(spark, sf):
    """The rules that need no file list, over one set of claims, verdicts and scores."""
    parsed, bad = nz.parse_lines(claim_lines(spark, sf))
    # Only what the rules ask for: parsed evidence is by far the largest part of a claim.
    asked = ("run_id", "claim_id", "stage", "subject", "subject_type", "decision_key")
    keyed = nz.claims_with_keys(parsed).select(*asked).persist()
    code = F.when(F.col("o_orderstatus") == "F", "EVIDENCE_ACCURATE").otherwise("EVIDENCE_MISSTATED")
    layer1 = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("claim_id"),
        code.alias("claim_layer1_code"),
        "o_orderkey",
    )
    layer2 = layer1.where("o_orderkey % 2 = 0").select("run_id", "claim_id")
    rows = [
        bad,
        nz.reference_violations(keyed, {"claim_verdicts.jsonl": layer1}),
        nz.gate_violations(keyed, layer1, layer2),
        nz.unkeyable(keyed),
    ]
    return union_all(rows).select("run_id", "rule", "record_key")
