"""Run artifacts as the twelve typed tables, with a data-quality row for every violation.

Each artifact kind is handled for all runs at once. Lines stay lines: what one claim needs (its
evidence array) is computed inside its row, so no step gathers a run.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.joins import layer2_gate, orphans
from plumbline.operators.quality import missing_artifacts, quality_rows
from plumbline.plans.audit import ACCURATE
from plumbline.profile.univariate import union_all
from plumbline.sources import runs as run_source
from plumbline.sources.schemas import REQUIRED, REQUIRED_BY_ARM, TABLES, schema

# EDA flag to decision.
FLAG_DECISIONS = {
    "has_high_missing": "flag_high_missing",
    "has_moderate_missing": "flag_missingness",
    "is_constant": "flag_constant",
    "is_duplicate_of_other_column": "flag_duplicate",
    "is_high_cardinality": "flag_high_cardinality",
    "is_id_like": "flag_identifier",
    "is_imbalanced": "flag_class_imbalance",
    "is_low_variance": "flag_low_variance",
    "is_multicollinear": "flag_multicollinearity",
    "is_numeric_but_categorical": "flag_numeric_categorical",
    "is_sequential": "flag_sequential",
    "is_skewed": "flag_skew",
    "is_zero_inflated": "flag_zero_inflation",
    "leakage_suspect": "flag_leakage",
    "missingness_informative": "flag_informative_missingness",
    "missingness_leakage_suspect": "flag_leakage",
}

CLAIM_JSON = (
    "claim_id string, stage string, decision string, confidence double, justification string, "
    "severity string, llm_stated_severity string, rule_derived_severity string, "
    "severity_rule_violation boolean, column string, action string, encoding string, "
    "imputation string, scaling string, is_override boolean, override_reason string, "
    "rule_derived_action string, model_id string, rank bigint, is_rejection boolean, "
    "primary_metric string, secondary_metrics array<string>, evidence variant"
)


def variant_kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def value_type(value: Column, kind: Column | None = None) -> Column:
    """null, bool, int, float, str, list or object; ``kind`` where it is a column already."""
    kind = variant_kind(value) if kind is None else kind
    return (
        F.when(value.isNull() | (kind == "VOID"), "null")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float")
        .when(kind == "STRING", "str")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "object")
    )


#: A float in the text of a list or object; without one a variant prints all that there is.
NESTED_FLOAT = r"[:\[,]\s*-?[0-9]+\.[0-9]"


@F.pandas_udf(T.StringType())
def sorted_json(texts: pd.Series) -> pd.Series:
    """JSON text with sorted keys, compact, numbers as they are; NULL stays NULL."""

    def printed(text):
        return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"), sort_keys=True)

    return texts.map(printed, na_action="ignore")


def canonical_json(value: Column, raw: Column | None = None, kind: Column | None = None) -> Column:
    """Compact JSON with sorted keys; a whole float keeps its ``.0``.

    A variant forgets the ``.0`` of floats inside lists and objects; ``raw``, the JSON text of the
    value, is asked for those. ``kind``: what ``value_type`` says, where it is a column already.
    """
    kind = value_type(value) if kind is None else kind
    text = F.coalesce(F.to_json(value), F.lit("null"))
    bare = (kind == "float") & ~text.rlike("[.eE]")
    text = F.when(bare, F.concat(text, F.lit(".0"))).otherwise(text)
    if raw is None:
        return text
    nested = kind.isin("list", "object") & raw.rlike(NESTED_FLOAT)
    return F.coalesce(sorted_json(F.when(nested, raw)), text)


#: White space between the tokens of JSON.
JSON_SPACE = " \t\n\r"


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed objects and malformed lines of a line file; blank lines are neither."""
    parsed = lines.where(F.trim("value") != "").withColumn("json", F.try_parse_json("value"))
    # What can be parsed is an object if it begins like one; its schema need not be worked out.
    is_object = F.col("json").isNotNull() & F.ltrim("value", F.lit(JSON_SPACE)).startswith("{")
    number = F.col("line_no").cast("string")
    message = F.when(
        F.col("json").isNull(), F.concat(F.lit("Could not parse JSON on line "), number)
    ).otherwise(F.concat(F.lit("JSON line "), number, F.lit(" is not an object")))
    bad = quality_rows(
        parsed.where(~is_object), "malformed_json", F.col("artifact"), message, F.concat(F.lit("line:"), number)
    )
    return parsed.where(is_object), bad


def parse_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed non-empty objects and malformed documents."""
    parsed = documents.withColumn("json", F.try_parse_json("value"))
    kind = variant_kind(F.col("json"))
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    message = F.when(F.col("json").isNull(), "Could not parse JSON").otherwise("JSON document is not an object")
    bad = quality_rows(parsed.where(~is_object), "malformed_json", F.col("artifact"), message)
    return parsed.where(is_object & (F.regexp_replace("value", r"\s", "") != "{}")), bad


def fields(parsed: DataFrame, ddl: str, *keep: str) -> DataFrame:
    """Typed fields of parsed JSON; unknown keys are ignored, missing or mistyped ones are NULL."""
    return parsed.select(*keep, F.from_json("value", ddl).alias("_f")).select(*keep, "_f.*")


def given(column: str) -> Column:
    """A transform that is present and not ``none``."""
    return F.col(column).isNotNull() & (F.col(column) != "none")


def plan_decision() -> Column:
    """Decision of a preprocessing claim; other actions have none."""
    action = F.col("action")
    return (
        F.when(action == "drop", "drop")
        .when((action == "scale") & given("scaling"), F.concat(F.lit("scale_"), "scaling"))
        .when((action == "encode") & given("encoding"), F.concat(F.lit("encode_"), "encoding"))
        .when(
            (action == "impute_and_scale") & given("imputation") & given("scaling"),
            F.concat(F.lit("impute_"), "imputation", F.lit("+scale_"), "scaling"),
        )
        .when(
            (action == "impute_and_encode") & given("imputation") & given("encoding"),
            F.concat(F.lit("impute_"), "imputation", F.lit("+encode_"), "encoding"),
        )
    )


def evidence_items(evidence: Column) -> Column:
    """Evidence objects of one claim with their position; entries that are no objects are left out."""
    items = F.coalesce(F.try_variant_get(evidence, "$", "array<variant>"), F.array().cast("array<variant>"))
    placed = F.transform(items, lambda e, i: F.struct(i.cast("bigint").alias("i"), e.alias("e")))
    return F.filter(placed, lambda p: F.coalesce(variant_kind(p["e"]).startswith("OBJECT"), F.lit(False)))


def claims_nested(item: Column) -> Column:
    """Whether the claimed value of an evidence object is a list or an object."""
    return variant_kind(F.try_variant_get(item["e"], "$.claimed_value", "variant")).rlike("^(ARRAY|OBJECT)")


def _cited(item: Column) -> Column:
    """Subject and flagged decision of one evidence object, as nullable fields."""
    key = F.try_variant_get(item["e"], "$.metric_key", "variant")
    text = F.when(variant_kind(key) == "STRING", F.try_variant_get(key, "$", "string"))
    parts = F.split(text, ":")
    n, first = F.size(parts), F.element_at(parts, 1)
    is_column, is_target = (first == "col") & (n >= 3), (first == "target") & (n >= 2)
    decisions = F.create_map(*[F.lit(x) for pair in FLAG_DECISIONS.items() for x in pair])
    claimed = F.try_variant_get(item["e"], "$.claimed_value", "variant")
    is_true = (variant_kind(claimed) == "BOOLEAN") & F.try_variant_get(claimed, "$", "boolean")
    return F.struct(
        F.when(is_column, "column").when(is_target, "dataset").alias("subject_type"),
        F.when(is_column, F.get(parts, F.lit(1))).when(is_target, F.col("dataset")).alias("subject"),
        F.when(F.coalesce(is_true, F.lit(False)), decisions[F.element_at(parts, -1)]).alias("decision"),
    )


def with_flag_choice(claims: DataFrame) -> DataFrame:
    """Adds ``_choice`` to EDA findings: the one (subject, decision) their TRUE flags agree on, else
    their one subject, else NULL.

    Each step is a column of its own, since an expression used twice in one column is computed twice.
    """
    eda = F.col("stage") == "eda"
    found = F.filter(F.transform("_items", _cited), lambda c: c["subject"].isNotNull())
    flagged = F.array_distinct(F.filter("_cited", lambda c: c["decision"].isNotNull()))
    subjects = F.array_distinct(
        F.transform(
            "_cited",
            lambda c: F.struct(
                c["subject_type"].alias("subject_type"),
                c["subject"].alias("subject"),
                F.lit(None).cast("string").alias("decision"),
            ),
        )
    )
    choice = F.when(F.size("_flagged") == 1, F.get("_flagged", F.lit(0))).when(
        F.size("_subjects") == 1, F.get("_subjects", F.lit(0))
    )
    return (
        claims.withColumn("_cited", F.when(eda, found))
        .withColumns({"_flagged": flagged, "_subjects": subjects})
        .withColumn("_choice", choice)
        .drop("_cited", "_flagged", "_subjects")
    )


def claims_with_keys(parsed: DataFrame) -> DataFrame:
    """Claims with a decision key read from structured fields only; ``parsed`` carries ``dataset``."""
    cited = F.from_json(F.get_json_object("value", "$.evidence"), "array<string>")
    raw = fields(parsed, CLAIM_JSON, "run_id", "line_no", "dataset", "value").withColumn("_items", evidence_items(F.col("evidence")))
    # The text of evidence is asked for floats inside lists and objects only.
    raw = raw.withColumn("_texts", F.when(F.exists("_items", claims_nested), cited))
    stage = F.col("stage")
    plan = (stage == "preprocess") & F.col("column").isNotNull()
    model = (stage == "model_selection") & F.col("model_id").isNotNull()
    metric = (stage == "evaluation") & F.col("primary_metric").isNotNull()
    rejects = F.when(F.col("is_rejection"), "reject").when(~F.col("is_rejection"), "accept")
    keyed = with_flag_choice(raw.withColumnRenamed("decision", "decision_text"))
    keyed = keyed.withColumns(
        {
            "subject_type": F.when(plan, "column").when(model, "model").when(metric, "metric").otherwise(
                F.col("_choice.subject_type")
            ),
            "subject": F.when(plan, F.col("column"))
            .when(model, F.col("model_id"))
            .when(metric, F.col("primary_metric"))
            .otherwise(F.col("_choice.subject")),
            "decision": F.when(plan, plan_decision())
            .when(model, rejects)
            .when(metric, F.lit("select"))
            .otherwise(F.col("_choice.decision")),
        }
    )
    # concat is NULL when any part is.
    return keyed.withColumn(
        "decision_key", F.concat("stage", F.lit("|"), "subject", F.lit("|"), "decision")
    ).drop("_choice", "evidence", "value")


def evidence_refs(keyed: DataFrame) -> DataFrame:
    """One row per evidence object, with its position, value type and canonical value.

    Each step is a column of its own, as in ``with_flag_choice``.
    """
    def with_text(item):
        return F.struct(item["i"].alias("i"), item["e"].alias("e"), F.get("_texts", item["i"].cast("int")).alias("text"))

    item = F.explode(F.transform("_items", with_text)).alias("_item")
    value, kind = F.col("_value"), F.col("claimed_value_type")
    return (
        keyed.select("run_id", "claim_id", item)
        .select(
            "run_id",
            "claim_id",
            F.col("_item.i").alias("evidence_index"),
            F.try_variant_get(F.col("_item.e"), "$.metric_key", "string").alias("metric_key"),
            F.try_variant_get(F.col("_item.e"), "$.claimed_value", "variant").alias("_value"),
            F.col("_item.text").alias("_text"),
        )
        .withColumn("_kind", variant_kind(value))
        .withColumn("claimed_value_type", value_type(value, F.col("_kind")))
        .withColumn("claimed_value_json", canonical_json(value, F.get_json_object("_text", "$.claimed_value"), kind))
        .drop("_kind", "_value", "_text")
    )


def unkeyable(keyed: DataFrame) -> DataFrame:
    """Quality rows of claims without a decision key.

    Rows without one are unpacked from a list of one, not filtered: Spark would move the filter to where the lines are
    read and write out there every step from the line to the key anew, each as often as the next one uses it.
    """
    row = F.struct("run_id", "claim_id", "stage", "subject", "subject_type")
    keyed = keyed.select(F.inline(F.when(F.col("decision_key").isNull(), F.array(row))))
    details = F.to_json(
        F.struct("stage", "subject", "subject_type"), {"ignoreNullFields": "false"}
    )
    return quality_rows(
        keyed,
        "unkeyable_claim",
        F.lit("claims.jsonl"),
        F.lit("Claim cannot be keyed from structured fields without parsing prose"),
        F.col("claim_id"),
        "warning",
        details,
    )


def model_evaluations(parsed: DataFrame) -> DataFrame:
    ddl = TABLES["model_evaluations"].removeprefix("run_id string, ")
    return fields(parsed, ddl, "run_id")


def evaluation_metrics(parsed: DataFrame) -> DataFrame:
    """The primary metric and every secondary metric as rows."""
    ddl = (
        "model_id string, primary_metric string, primary_metric_mean double, primary_metric_std double, "
        "secondary_metrics map<string, struct<mean: double, std: double>>"
    )
    raw = fields(parsed, ddl, "run_id")
    primary = raw.where("primary_metric is not null").select(
        "run_id",
        "model_id",
        F.lit("primary").alias("metric_role"),
        F.col("primary_metric").alias("metric_name"),
        F.col("primary_metric_mean").alias("mean"),
        F.col("primary_metric_std").alias("std"),
    )
    secondary = raw.select("run_id", "model_id", F.explode("secondary_metrics").alias("metric_name", "_v")).select(
        "run_id", "model_id", F.lit("secondary").alias("metric_role"), "metric_name", "_v.mean", "_v.std"
    )
    return primary.unionByName(secondary)


def prompt_calls(parsed: DataFrame) -> DataFrame:
    """One row per call with its position among the readable lines."""
    placed = run_source.position(parsed, "run_id", "line_no", "call_index")

    def get(path, sql_type):
        return F.try_variant_get("json", path, sql_type)

    return placed.select(
        "run_id",
        "call_index",
        get("$.stage", "string").alias("stage"),
        get("$.latency_seconds", "double").alias("latency_seconds"),
        get("$.tokens.input", "bigint").alias("input_tokens"),
        get("$.tokens.output", "bigint").alias("output_tokens"),
        get("$.prompt.model", "string").alias("prompt_model"),
        get("$.prompt.temperature", "double").alias("temperature"),
        get("$.prompt.max_tokens", "bigint").alias("max_tokens"),
        get("$.raw_response.id", "string").alias("response_id"),
        get("$.raw_response.model", "string").alias("response_model"),
        get("$.raw_response.stop_reason", "string").alias("stop_reason"),
        canonical_json(get("$.error", "variant"), F.get_json_object("value", "$.error")).alias("error_json"),
        canonical_json(get("$.prompt", "variant"), F.get_json_object("value", "$.prompt")).alias("prompt_json"),
        canonical_json(get("$.raw_response", "variant"), F.get_json_object("value", "$.raw_response")).alias("raw_response_json"),
    )


def run_metrics(documents: DataFrame) -> DataFrame:
    """Reported metrics per run and arm from parsed documents that carry ``arm``.

    An AB run reports arm A from its own file, else from the common one, and arm B; a C run reports
    from the common file.
    """
    ddl = TABLES["run_metrics"].split("source_artifact string, ")[1]
    stages = ("eda", "preprocess", "model_selection", "evaluation")
    plain = ", ".join(p for p in ddl.split(", ") if not p.startswith(("mean_layer2_score_", "stage_fallbacks")))
    raw = fields(documents, f"{plain}, mean_layer2_score_by_stage map<string, double>", "run_id", "arm", "artifact", "json")
    by_stage = F.col("mean_layer2_score_by_stage")
    fallbacks = F.try_variant_get("json", "$.stage_fallbacks", "variant")
    empty = F.coalesce(value_type(fallbacks), F.lit("null")) == "null"
    raw = raw.withColumns({f"mean_layer2_score_{s}": by_stage[s] for s in stages}).withColumn(
        "stage_fallbacks_json", F.when(empty, "{}").otherwise(canonical_json(fallbacks))
    )
    own = raw.where("arm = 'ab' and artifact = 'arm_a_metrics.json'").select("run_id")
    common = raw.where("artifact = 'metrics.json'").join(own, "run_id", "left_anti")
    primary = raw.where("arm = 'ab' and artifact = 'arm_a_metrics.json'").unionByName(common)
    reported = primary.withColumn("reported_arm", F.when(F.col("arm") == "ab", "A").otherwise("C")).unionByName(
        raw.where("arm = 'ab' and artifact = 'arm_b_metrics.json'").withColumn("reported_arm", F.lit("B"))
    )
    return reported.withColumnRenamed("artifact", "source_artifact")


def planted_defects(documents: DataFrame) -> DataFrame:
    """Recall rows of C runs with the measured and profiled value of their defect."""
    recall = fields(
        documents.where("artifact = 'arm_c_recall.json'"),
        "defects array<struct<defect: string, column: string, expected_metric_key: string, "
        "recalled: boolean, matching_claim_ids: array<string>>>",
        "run_id",
    ).select("run_id", F.inline("defects"))
    corruption = fields(
        documents.where("artifact = 'synthetic_corruption.json'"),
        "seed bigint, constant_nunique double, leaked_corr_with_target double, high_missing_pct double, "
        "profile struct<leaked_corr_with_target: double, constant_is_constant: boolean, "
        "leaked_leakage_suspect: boolean, high_missing_has_high_missing: boolean>",
        "run_id",
    )
    defect = F.col("defect")
    return recall.join(corruption, "run_id").select(
        "run_id",
        "defect",
        F.col("column").alias("column_name"),
        "expected_metric_key",
        "recalled",
        "matching_claim_ids",
        "seed",
        F.when(defect == "constant", F.col("constant_nunique"))
        .when(defect == "leakage", F.col("leaked_corr_with_target"))
        .when(defect == "high_missing", F.col("high_missing_pct"))
        .alias("observed_value"),
        F.when(defect == "leakage", F.col("profile.leaked_corr_with_target")).alias("profile_value"),
        F.when(defect == "constant", F.col("profile.constant_is_constant"))
        .when(defect == "leakage", F.col("profile.leaked_leakage_suspect"))
        .when(defect == "high_missing", F.col("profile.high_missing_has_high_missing"))
        .alias("profile_detected"),
    )


def required_artifacts(spark: SparkSession) -> DataFrame:
    rows = [(arm, name) for arm, extra in REQUIRED_BY_ARM.items() for name in (*REQUIRED, *extra)]
    return spark.createDataFrame(rows, "arm string, artifact string")


def reference_violations(claims: DataFrame, verdict_tables: dict[str, DataFrame]) -> DataFrame:
    """Verdict rows whose claim does not exist, per artifact."""
    keys = ["run_id", "claim_id"]
    return union_all(
        [
            quality_rows(
                orphans(rows, claims, keys),
                "orphan_claim_id",
                F.lit(artifact),
                F.lit("Verdict references a claim_id not present in claims.jsonl"),
                F.col("claim_id"),
            )
            for artifact, rows in verdict_tables.items()
        ]
    )


def gate_violations(claims: DataFrame, layer1: DataFrame, layer2: DataFrame) -> DataFrame:
    """Accurate claims without a score, and scores of claims that are not accurate."""
    keys = ["run_id", "claim_id"]
    known = claims.where("claim_id is not null").select(*keys)
    accurate = layer1.where(F.col("claim_layer1_code") == ACCURATE).join(known, keys, "left_semi")
    gate = layer2_gate(accurate, layer2, keys)
    missed, extra = (gate.where(F.col("rule") == r) for r in ("layer2_missing_eligible", "layer2_ineligible_claim"))
    artifact = F.lit("layer2_verdicts.jsonl")
    return quality_rows(
        missed,
        "layer2_missing_eligible",
        artifact,
        F.lit("Layer-1-eligible claim has no Layer 2 verdict"),
        F.col("claim_id"),
    ).unionByName(
        quality_rows(
            extra,
            "layer2_ineligible_claim",
            artifact,
            F.lit("Layer 2 verdict exists for a claim that is not Layer-1 eligible"),
            F.col("claim_id"),
        )
    )


@dataclass
class RunArtifacts:
    """Line and document frames of a set of runs, and the files present."""

    runs: DataFrame  # run_id, source_run_dir
    files: DataFrame  # run_id, artifact
    lines: dict[str, DataFrame]  # artifact -> run_id, artifact, line_no, value
    documents: dict[str, DataFrame]  # artifact -> run_id, artifact, value


LINE_FILES = (
    "claims.jsonl",
    "claim_verdicts.jsonl",
    "evidence_verdicts.jsonl",
    "layer2_verdicts.jsonl",
    "evaluation_results.jsonl",
    "prompts.jsonl",
)
DOCUMENT_FILES = (
    "experiment_metadata.json",
    "metrics.json",
    "arm_a_metrics.json",
    "arm_b_metrics.json",
    "preregistration_comparison.json",
    "arm_c_recall.json",
    "synthetic_corruption.json",
)
AB_ONLY = ("arm_a_metrics.json", "arm_b_metrics.json", "preregistration_comparison.json")
C_ONLY = ("arm_c_recall.json", "synthetic_corruption.json")


def read_artifacts(spark: SparkSession, root: str | run_source.RunFolder) -> RunArtifacts:
    folder = run_source.open_runs(spark, root)
    files = run_source.run_files(spark, folder)
    return RunArtifacts(
        runs=files.select("run_id", "source_run_dir").distinct(),
        files=files.select("run_id", "artifact"),
        lines={a: run_source.artifact_lines(spark, folder, a) for a in LINE_FILES},
        documents={a: run_source.artifact_documents(spark, folder, a) for a in DOCUMENT_FILES},
    )


def normalize_runs(
    artifacts: RunArtifacts, stored: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None
) -> dict[str, DataFrame]:
    """The twelve tables.

    ``stored(tables)`` gives back what they hold once they are written. Claims and verdicts are read again for the
    references between them, so they come from there; without it, claims are kept for the session.
    """
    stored = stored or (lambda tables: {name: t.persist() if name == "claims" else t for name, t in tables.items()})
    spark = artifacts.runs.sparkSession
    identity = artifacts.runs.select("run_id", "source_run_dir", *run_source.run_identity(F.col("run_id")))
    arms = identity.select("run_id", "arm", "dataset")
    quality = [
        quality_rows(
            missing_artifacts(arms, required_artifacts(spark), artifacts.files),
            "missing_required_file",
            F.col("artifact"),
            F.concat(F.lit("Required artifact '"), "artifact", F.lit("' is missing")),
        )
    ]
    parsed: dict[str, DataFrame] = {}
    for name, lines in artifacts.lines.items():
        parsed[name], bad = parse_lines(lines)
        quality.append(bad)
    documents = []
    for name, frame in artifacts.documents.items():
        scope = F.col("arm") == "ab" if name in AB_ONLY else F.col("arm") == "c" if name in C_ONLY else F.lit(True)
        good, bad = parse_documents(frame.join(arms.where(scope).drop("dataset"), "run_id"))
        documents.append(good)
        quality.append(bad)
    all_documents = union_all(documents)

    metadata = fields(
        all_documents.where("artifact = 'experiment_metadata.json'"),
        "task_type string, target_column string, source_dataset_path string, dataset_path string, "
        "preregistration_path string, preregistration_sha256 string, call_cap_used bigint, "
        "reported_arms array<string>, planted_columns array<string>, manual_dataset_corrections variant",
        "run_id",
    )
    corrections = F.col("manual_dataset_corrections")
    runs = identity.join(metadata, "run_id", "left").withColumn(
        "manual_dataset_corrections_json",
        F.when(value_type(corrections) == "null", "[]").otherwise(canonical_json(corrections)),
    )
    keyed = claims_with_keys(parsed["claims.jsonl"].join(F.broadcast(arms.select("run_id", "dataset")), "run_id"))

    def simple(artifact, table, *extra):
        skip = {"run_id", *[name for name, _ in extra]}
        ddl = ", ".join(p for p in TABLES[table].split(", ") if p.split()[0] not in skip)
        rows = fields(parsed[artifact], ddl, "run_id", "line_no")
        for name, column in extra:
            rows = rows.withColumn(name, column)
        return rows

    tables = {
        "claims": keyed,
        "evidence_refs": evidence_refs(keyed),
        "layer1_claim_verdicts": simple("claim_verdicts.jsonl", "layer1_claim_verdicts"),
        "layer1_evidence_verdicts": simple(
            "evidence_verdicts.jsonl", "layer1_evidence_verdicts", ("evidence_index", F.col("line_no") - 1)
        ),
        "layer2_verdicts": simple("layer2_verdicts.jsonl", "layer2_verdicts"),
        "runs": runs,
        "run_metrics": run_metrics(all_documents),
        "model_evaluations": model_evaluations(parsed["evaluation_results.jsonl"]),
        "model_evaluation_metrics": evaluation_metrics(parsed["evaluation_results.jsonl"]),
        "prompt_calls": prompt_calls(parsed["prompts.jsonl"]),
        "arm_c_defects": planted_defects(all_documents),
    }
    tables = stored({name: conform(frame, name) for name, frame in tables.items()})
    claims, layer1, layer2 = (tables[name] for name in ("claims", "layer1_claim_verdicts", "layer2_verdicts"))
    verdicts = {
        "claim_verdicts.jsonl": layer1,
        "evidence_verdicts.jsonl": tables["layer1_evidence_verdicts"],
        "layer2_verdicts.jsonl": layer2,
    }
    # Keys that repeat in pattern are small in a file; by its size Spark would send them all to the driver for a broadcast.
    known = claims.hint("merge")
    quality += [unkeyable(claims), reference_violations(known, verdicts), gate_violations(known, layer1, layer2)]
    return tables | stored({"data_quality": conform(union_all(quality), "data_quality")})


def conform(frame: DataFrame, table: str) -> DataFrame:
    """The declared columns in order and type; text that is no number becomes NULL."""
    return frame.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema(table).fields])
