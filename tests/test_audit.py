import pytest
from pyspark.sql import functions as F

from plumbline.plans import audit, gold

EVIDENCE = "claim_id string, metric_key string, claimed_num double, claimed_bool boolean, claimed_str string, claimed_map map<string,double>"
PROFILE = "metric_key string, real_num double, real_bool boolean, real_str string, real_map map<string,double>"

REAL = [
    ("n", 100.0, None, None, None),
    ("zero", 0.0, None, None, None),
    ("flag", None, False, None, None),
    ("text", None, None, "mean", None),
    ("none", None, None, None, None),
    ("balance", None, None, None, {"0": 0.8, "1": 0.2}),
]


@pytest.mark.parametrize(
    "key, claimed, code",
    [
        ("n", {"num": 101.0}, audit.ACCURATE),
        ("n", {"num": 99.0}, audit.ACCURATE),
        ("n", {"num": 101.5}, audit.MISSTATED),
        ("n", {"bool": True}, audit.MISSTATED),
        ("n", {}, audit.MISSTATED),
        ("zero", {"num": 0.0}, audit.ACCURATE),
        ("zero", {"num": 1e-11}, audit.ACCURATE),
        ("zero", {"num": 0.1}, audit.MISSTATED),
        ("flag", {"bool": False}, audit.ACCURATE),
        ("flag", {"num": 0.0}, audit.MISSTATED),
        ("text", {"str": "mean"}, audit.ACCURATE),
        ("text", {"str": "Mean"}, audit.MISSTATED),
        ("none", {}, audit.ACCURATE),
        ("none", {"num": 12.3}, audit.FABRICATED),
        ("absent", {"num": 1.0}, audit.FABRICATED),
        ("absent", {}, audit.FABRICATED),
        ("balance", {"map": {"0": 0.801, "1": 0.2}}, audit.ACCURATE),
        ("balance", {"map": {"0": 0.9, "1": 0.1}}, audit.MISSTATED),
        ("balance", {"map": {"0": 0.8}}, audit.MISSTATED),
        ("balance", {"map": {"0": 0.8, "2": 0.2}}, audit.MISSTATED),
        ("balance", {"num": 0.8}, audit.MISSTATED),
        ("balance[1]", {"num": 0.2}, audit.ACCURATE),
        ("balance[1]", {"num": 0.3}, audit.MISSTATED),
        ("balance[7]", {"num": 0.3}, audit.FABRICATED),
        ("n[1]", {"num": 0.3}, audit.FABRICATED),
    ],
)
def test_evidence_rules(spark, key, claimed, code):
    evidence = spark.createDataFrame([("c", key, *[claimed.get(k) for k in ("num", "bool", "str", "map")])], EVIDENCE)
    profile = spark.createDataFrame(REAL, PROFILE)
    judged = audit.verdicts(audit.resolve_with_subkeys(evidence, profile)).collect()
    assert [(r["metric_key"], r["layer1_code"]) for r in judged] == [(key, code)]


def test_roll_up_precedence_and_citationless_claims(spark, rows):
    claims = spark.createDataFrame([("a",), ("b",), ("c",)], "claim_id string")
    cited = spark.createDataFrame(
        [("a", audit.ACCURATE), ("a", audit.FABRICATED), ("a", audit.MISSTATED), ("b", audit.MISSTATED)],
        "claim_id string, layer1_code string",
    )
    rolled = audit.roll_up(claims, cited, ["claim_id"])
    assert rows(rolled, "claim_id", "claim_layer1_code") == [
        ("a", audit.FABRICATED), ("b", audit.MISSTATED), ("c", audit.ACCURATE),
    ]


def test_rates_are_null_without_citations(spark):
    claims = spark.createDataFrame([("a", "eda")], "claim_id string, stage string")
    none = spark.createDataFrame([], "claim_id string, layer1_code string")
    row = audit.audit_rates(audit.roll_up(claims, none, ["claim_id"]), ["stage"]).first()
    assert row["citation_fabrication_rate"] is None and row["claim_fabrication_rate"] == 0.0


def test_code_chunks_hold_every_code_in_order(spark):
    cited = spark.range(2500).select(
        F.lit("hot").alias("claim_id"), F.col("id").alias("evidence_index"), F.col("id").cast("string").alias("layer1_code")
    )
    chunks = audit.citation_code_chunks(cited.repartition(7), ["claim_id"]).orderBy("chunk").collect()
    assert [len(c["citation_layer1_codes"]) for c in chunks] == [1024, 1024, 452]
    assert [x for c in chunks for x in c["citation_layer1_codes"]] == [str(i) for i in range(2500)]


@pytest.mark.parametrize(
    "refs, severity",
    [
        ([("col:a:leakage_suspect", True)], "critical"),
        ([("col:a:leakage_suspect", False)], "info"),
        ([("col:a:is_skewed", True)], "warn"),
        ([("col:a:is_skewed", True), ("target:is_imbalanced", True)], "critical"),
        ([("col:a:is_imbalanced", True)], "info"),
        ([("col:a:mean", None)], "info"),
    ],
)
def test_severity(spark, refs, severity):
    claims = spark.createDataFrame([("a", "info")], "claim_id string, llm_stated_severity string")
    evidence = spark.createDataFrame([("a", *r) for r in refs], "claim_id string, metric_key string, claimed_bool boolean")
    row = audit.annotate_severity(audit.derived_severity(claims, evidence, ["claim_id"])).first()
    assert row["severity"] == severity and row["severity_rule_violation"] == (severity != "info")


def test_allowed_evidence(spark, rows):
    profile = spark.createDataFrame(
        [("n_rows", None), ("n_cols", None), ("col:a:mean", "a"), ("col:b:mean", "b")],
        "metric_key string, column_name string",
    )
    kept = spark.createDataFrame([("a",)], "column_name string")
    assert rows(audit.allowed_evidence(profile, kept)) == [("col:a:mean",), ("n_rows",)]


def test_layer2_metrics_keep_stages_without_scores(spark):
    claims = spark.createDataFrame([("a", "eda"), ("b", "preprocess")], "claim_id string, stage string")
    scores = spark.createDataFrame([("a", 0)], "claim_id string, layer2_score bigint")
    got = {r["stage"]: r for r in audit.layer2_metrics(claims, scores, ["stage"], ["claim_id"]).collect()}
    assert got["eda"]["mischaracterization_rate"] == 1.0 and got["eda"]["wrong_direction_rate"] == 0.0
    assert got["preprocess"]["mean_layer2_score"] is None and got["preprocess"]["layer2_claims_scored"] == 0


def test_consistency_needs_two_runs_and_holds_any_number(spark):
    per_run = spark.createDataFrame(
        [("d", "k", f"r{i}", s) for i, s in enumerate((3, 1, 3, 1))] + [("d", "single", "r0", 2)],
        "dataset string, decision_key string, run_id string, layer2_score bigint",
    )
    got = gold.decision_consistency(per_run).collect()
    assert len(got) == 1 and (got[0]["score_1_count"], got[0]["score_3_count"]) == (2, 2) and got[0]["score_spread"] == 2
    many = spark.range(10_001).select(
        F.lit("d").alias("dataset"), F.lit("k").alias("decision_key"), F.col("id").cast("string").alias("run_id"),
        (F.col("id") % 4).alias("layer2_score"),
    )
    row = gold.decision_consistency(many).first()
    assert row["run_count"] == 10_001 and row["score_0_count"] == 2501 and not [c for c in row.asDict().values() if c is None]


def test_expected_scores(spark):
    runs = spark.createDataFrame([(f"r{i}", "x", "ab") for i in range(4)], "run_id string, dataset string, arm string")
    enriched = spark.createDataFrame(
        [(f"r{i}", "m|knn|reject", s) for i, s in enumerate((3, 1, 1, 3))], "run_id string, decision_key string, layer2_score bigint"
    )
    ok = gold.expected_scores(enriched, runs, "x", "ab", "m|knn|reject", [1, 1, 3, 3]).first()
    other = gold.expected_scores(enriched, runs, "x", "ab", "m|knn|reject", [2, 3, 3, 3]).first()
    assert ok["matches_expected"] and not other["matches_expected"]


def test_detection_counts_null_outcome_as_neither(spark):
    runs = spark.createDataFrame([("r", "d")], "run_id string, dataset string")
    defects = spark.createDataFrame(
        [("r", "leak", "a", True), ("r", "leak", "b", False), ("r", "leak", "c", None)],
        "run_id string, defect string, column_name string, recalled boolean",
    )
    row = gold.detection(defects, runs).first()
    assert (row["planted_count"], row["detected_count"], row["missed_columns"]) == (3, 1, ["b"])


def test_keys_as_written_win_over_map_entries(spark):
    profile = spark.createDataFrame(
        [("balance", None, None, None, {"1": 0.2, "a[b": 0.3, "": 0.5}), ("balance[1]", 9.0, None, None, None)], PROFILE
    )
    found = {r["metric_key"]: r["real_num"] for r in audit.citable(profile).collect()}
    assert found == {"balance": None, "balance[1]": 9.0}
    kinds = {r["metric_key"]: r["real_map"] is not None for r in audit.citable(profile).collect()}
    assert kinds == {"balance": True, "balance[1]": False}


def test_maps_as_rows(spark):
    real = spark.createDataFrame(
        [("right", "a", 0.5), ("right", None, 0.5), ("few", "a", 0.5), ("few", "b", 0.5), ("off", "a", 1.0), ("twice", "a", 1.0),
         ("unclaimed", "a", 1.0), ("unknown", "a", None)],
        "metric_key string, sub_key string, value double",
    )
    claimed = spark.createDataFrame(
        [("right", "a", 0.501), ("right", None, 0.5), ("few", "a", 0.5), ("off", "a", 1.2), ("twice", "a", 1.0), ("twice", "a", 1.0),
         ("invented", "a", 1.0), ("unknown", "a", 1.0)],
        "metric_key string, sub_key string, value double",
    )
    codes = {r["metric_key"]: r["layer1_code"] for r in audit.map_verdicts(claimed, real).collect()}
    assert codes == {
        "right": audit.ACCURATE, "few": audit.MISSTATED, "off": audit.MISSTATED, "twice": audit.MISSTATED,
        "invented": audit.FABRICATED, "unknown": audit.MISSTATED,
    }
    assert audit.map_verdicts(claimed.limit(0), real).count() == 0
