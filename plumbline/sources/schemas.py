"""The twelve normalized tables: columns, grains and the files they come from."""

from __future__ import annotations

from pyspark.sql import types as T

# Run directory names.
RUN_NAME = r"^m9_([a-z0-9_]+)_(ab|c)_t(00|07)_r([0-9]+)$"

# Files every run must have, and those its arm adds.
REQUIRED = (
    "claims.jsonl",
    "claim_verdicts.jsonl",
    "evidence_verdicts.jsonl",
    "layer2_verdicts.jsonl",
    "evaluation_results.jsonl",
    "experiment_metadata.json",
    "metrics.json",
    "prompts.jsonl",
)
REQUIRED_BY_ARM = {
    "ab": ("arm_a_metrics.json", "arm_b_metrics.json", "preregistration_comparison.json"),
    "c": ("arm_c_recall.json", "synthetic_corruption.json", "input_dataset.csv"),
}

# Table columns.
TABLES = {
    "runs": (
        "run_id string, source_run_dir string, dataset string, arm string, temperature_code string, "
        "temperature double, repeat bigint, task_type string, target_column string, "
        "source_dataset_path string, dataset_path string, preregistration_path string, "
        "preregistration_sha256 string, call_cap_used bigint, reported_arms array<string>, "
        "planted_columns array<string>, manual_dataset_corrections_json string"
    ),
    "claims": (
        "run_id string, claim_id string, stage string, subject_type string, subject string, "
        "decision string, decision_key string, decision_text string, confidence double, "
        "justification string, severity string, llm_stated_severity string, "
        "rule_derived_severity string, severity_rule_violation boolean, column string, "
        "action string, encoding string, imputation string, scaling string, is_override boolean, "
        "override_reason string, rule_derived_action string, model_id string, rank bigint, "
        "is_rejection boolean, primary_metric string, secondary_metrics array<string>"
    ),
    "evidence_refs": (
        "run_id string, claim_id string, evidence_index bigint, metric_key string, "
        "claimed_value_type string, claimed_value_json string"
    ),
    "layer1_claim_verdicts": (
        "run_id string, claim_id string, stage string, citation_layer1_codes array<string>, "
        "claim_layer1_code string"
    ),
    "layer1_evidence_verdicts": (
        "run_id string, claim_id string, evidence_index bigint, metric_key string, layer1_code string"
    ),
    "layer2_verdicts": (
        "run_id string, claim_id string, layer2_score bigint, discrepancy_note string, "
        "critic_confidence double"
    ),
    "run_metrics": (
        "run_id string, reported_arm string, source_artifact string, run_completed boolean, "
        "run_aborted boolean, call_cap_used bigint, llm_call_count bigint, total_claims bigint, "
        "total_citations bigint, citation_fabrication_rate double, citation_misstatement_rate double, "
        "claim_fabrication_rate double, claim_misstatement_rate double, severity_violation_rate double, "
        "override_rate double, columns_kept bigint, columns_dropped bigint, preprocess_claims bigint, "
        "models_evaluated bigint, best_model_id string, best_primary_metric_value double, "
        "stratification_degraded boolean, wrong_direction_rate double, mischaracterization_rate double, "
        "layer2_claims_scored bigint, layer2_scale string, mean_layer2_score double, "
        "mean_layer2_score_eda double, mean_layer2_score_preprocess double, "
        "mean_layer2_score_model_selection double, mean_layer2_score_evaluation double, "
        "stage_fallbacks_json string"
    ),
    "model_evaluations": (
        "run_id string, model_id string, rank bigint, primary_metric string, "
        "primary_metric_mean double, primary_metric_std double, train_score_mean double, "
        "val_score_mean double, train_val_gap double, usable_folds bigint, overfitting_flag boolean"
    ),
    "model_evaluation_metrics": (
        "run_id string, model_id string, metric_role string, metric_name string, mean double, std double"
    ),
    "prompt_calls": (
        "run_id string, call_index bigint, stage string, latency_seconds double, input_tokens bigint, "
        "output_tokens bigint, prompt_model string, temperature double, max_tokens bigint, "
        "response_id string, response_model string, stop_reason string, error_json string, "
        "prompt_json string, raw_response_json string"
    ),
    "arm_c_defects": (
        "run_id string, defect string, column_name string, expected_metric_key string, "
        "recalled boolean, matching_claim_ids array<string>, seed bigint, observed_value double, "
        "profile_value double, profile_detected boolean"
    ),
    "data_quality": (
        "run_id string, rule string, severity string, artifact string, record_key string, "
        "message string, details_json string"
    ),
}

# One row per these keys. Evidence verdicts carry their position, so a key cited twice stays twice.
GRAINS = {
    "runs": ("run_id",),
    "claims": ("run_id", "claim_id"),
    "evidence_refs": ("run_id", "claim_id", "evidence_index"),
    "layer1_claim_verdicts": ("run_id", "claim_id"),
    "layer1_evidence_verdicts": ("run_id", "claim_id", "evidence_index", "metric_key"),
    "layer2_verdicts": ("run_id", "claim_id"),
    "run_metrics": ("run_id", "reported_arm"),
    "model_evaluations": ("run_id", "model_id"),
    "model_evaluation_metrics": ("run_id", "model_id", "metric_role", "metric_name"),
    "prompt_calls": ("run_id", "call_index"),
    "arm_c_defects": ("run_id", "defect"),
    "data_quality": ("run_id", "rule", "artifact", "record_key", "message"),
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
