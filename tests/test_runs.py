import json

import pytest
from pyspark.sql import functions as F

from plumbline.plans.normalize import claims_with_keys, evidence_refs, normalize_runs, parse_lines, read_artifacts, unkeyable
from plumbline.sinks import backfill, export, lakehouse
from plumbline.sources import delimited, secrets
from plumbline.sources import runs as run_source
from plumbline.sources.schemas import GRAINS, TABLES, schema


def write(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records), encoding="utf-8")


def good_run(root):
    run = root / "m9_mini_c_t07_r2"
    claims = [
        {"claim_id": "e1", "stage": "eda", "decision": "leak", "confidence": 0.9, "severity": "critical",
         "evidence": [{"metric_key": "col:LEAK:leakage_suspect", "claimed_value": True}]},
        {"claim_id": "p1", "stage": "preprocess", "column": "age", "action": "impute_and_scale", "imputation": "mean",
         "scaling": "robust", "encoding": "none", "is_override": False,
         "evidence": [{"metric_key": "col:age:missing_pct", "claimed_value": 15.0}]},
        {"claim_id": "m1", "stage": "model_selection", "model_id": "rf", "rank": 1, "is_rejection": False,
         "evidence": [{"metric_key": "n_rows", "claimed_value": 12}]},
        {"claim_id": "v1", "stage": "evaluation", "primary_metric": "rmse", "secondary_metrics": ["mae"],
         "evidence": [{"metric_key": "target_class_balance", "claimed_value": {"b": 1, "a": None}}]},
    ]
    write(run / "claims.jsonl", *claims)
    write(run / "claim_verdicts.jsonl", *[
        {"claim_id": c["claim_id"], "stage": c["stage"], "citation_layer1_codes": ["EVIDENCE_ACCURATE"],
         "claim_layer1_code": "EVIDENCE_ACCURATE"} for c in claims])
    write(run / "evidence_verdicts.jsonl", *[
        {"claim_id": c["claim_id"], "metric_key": c["evidence"][0]["metric_key"], "layer1_code": "EVIDENCE_ACCURATE"} for c in claims])
    write(run / "layer2_verdicts.jsonl", *[
        {"claim_id": c["claim_id"], "layer2_score": 3, "discrepancy_note": "", "critic_confidence": 0.5} for c in claims])
    write(run / "evaluation_results.jsonl", {
        "model_id": "rf", "rank": 1, "primary_metric": "rmse", "primary_metric_mean": 2.5, "primary_metric_std": 0.1,
        "secondary_metrics": {"mae": {"mean": 2.0, "std": 0.2}}, "usable_folds": 5, "overfitting_flag": False})
    write(run / "prompts.jsonl",
          {"stage": "eda", "tokens": {"input": 3, "output": 4}, "prompt": {"model": "m-1"}, "raw_response": {"id": "x"}},
          "", "not json", {"stage": "critic_eda", "prompt": {"model": "m-2"}})
    write(run / "experiment_metadata.json", {"task_type": "regression", "target_column": "y", "planted_columns": ["LEAK"],
                                             "manual_dataset_corrections": [{"z": 1, "a": 2}]})
    write(run / "metrics.json", {"run_completed": True, "best_model_id": "rf", "best_primary_metric_value": 2.5,
                                 "mean_layer2_score_by_stage": {"eda": 3.0}, "override_rate": 0.25})
    write(run / "arm_c_recall.json", {"defects": [
        {"defect": "leakage", "column": "LEAK", "expected_metric_key": "col:LEAK:leakage_suspect", "recalled": True,
         "matching_claim_ids": ["e1"]}]})
    write(run / "synthetic_corruption.json", {"seed": 5, "leaked_corr_with_target": 0.99,
                                              "profile": {"leaked_corr_with_target": 0.98, "leaked_leakage_suspect": True}})
    write(run / "input_dataset.csv", "age,y", "1,2")
    write(run / "extra" / "runs" / "claims.jsonl", {"claim_id": "not one of ours"})


def broken_run(root):
    run = root / "m9_bad_ab_t00_r1"
    write(run / "claims.jsonl",
          {"claim_id": "drop_it", "stage": "preprocess", "column": "id", "action": "drop", "evidence": []},
          {"claim_id": "refused", "stage": "model_selection", "model_id": "knn", "is_rejection": True},
          {"claim_id": "prose", "stage": "eda", "evidence": [{"metric_key": "col:age:mean", "claimed_value": 0.2}, 5]},
          '{"claim_id": ')
    write(run / "claim_verdicts.jsonl",
          {"claim_id": "drop_it", "claim_layer1_code": "EVIDENCE_ACCURATE", "citation_layer1_codes": []},
          {"claim_id": "refused", "claim_layer1_code": "EVIDENCE_MISSTATED"},
          {"claim_id": "prose", "claim_layer1_code": "EVIDENCE_ACCURATE"},
          {"claim_id": "ghost", "claim_layer1_code": "EVIDENCE_MISSTATED"})
    write(run / "layer2_verdicts.jsonl", {"claim_id": "refused", "layer2_score": 2}, {"claim_id": "prose", "layer2_score": 1})
    write(run / "evaluation_results.jsonl", {"model_id": "knn", "primary_metric": "roc_auc", "primary_metric_mean": 0.7})
    write(run / "prompts.jsonl", {"stage": "eda"})
    for name in ("experiment_metadata.json", "metrics.json", "arm_a_metrics.json", "arm_b_metrics.json"):
        write(run / name, {"total_claims": 3})
    write(run / "preregistration_comparison.json", "{}")


@pytest.fixture(scope="module")
def runs_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus") / "runs"
    good_run(root)
    broken_run(root)
    write(root / "m9_mini_c_t10_r1" / "claims.jsonl", {"claim_id": "x"})
    write(root / "m9_mini_ab_t00_r1_old" / "claims.jsonl", {"claim_id": "x"})
    write(root / "notes" / "claims.jsonl", {"claim_id": "x"})
    write(root / "loose.jsonl", {"claim_id": "x"})
    return str(root)


@pytest.fixture(scope="module")
def tables(spark, runs_dir):
    return {name: t.persist() for name, t in normalize_runs(read_artifacts(spark, runs_dir)).items()}


def test_discovery_follows_the_name_grammar(spark, runs_dir, rows):
    found = run_source.run_files(spark, runs_dir).select("run_id").distinct()
    assert rows(found) == [("m9_bad_ab_t00_r1",), ("m9_mini_c_t07_r2",)]
    assert run_source.run_files(spark, runs_dir).where("artifact = 'extra/runs/claims.jsonl'").count() == 1
    by_scheme = run_source.run_files(spark, f"file://{runs_dir}").select("run_id").distinct()
    assert rows(by_scheme) == rows(found)
    refused = {r["name"] for r in run_source.rejected_directories(spark, runs_dir).collect()}
    assert {"m9_mini_c_t10_r1", "m9_mini_ab_t00_r1_old", "notes"} <= refused


def test_row_counts_and_schemas(tables):
    counts = {name: t.count() for name, t in tables.items()}
    assert counts == {
        "runs": 2, "claims": 7, "evidence_refs": 5, "layer1_claim_verdicts": 8, "layer1_evidence_verdicts": 4,
        "layer2_verdicts": 6, "run_metrics": 3, "model_evaluations": 2, "model_evaluation_metrics": 3,
        "prompt_calls": 3, "arm_c_defects": 1, "data_quality": 7,
    }
    for name, t in tables.items():
        assert [f.dataType for f in t.schema.fields] == [f.dataType for f in schema(name).fields], name


def test_decision_keys(tables, rows):
    assert rows(tables["claims"], "claim_id", "decision_key") == [
        ("drop_it", "preprocess|id|drop"), ("e1", "eda|LEAK|flag_leakage"), ("m1", "model_selection|rf|accept"),
        ("p1", "preprocess|age|impute_mean+scale_robust"), ("prose", None),
        ("refused", "model_selection|knn|reject"), ("v1", "evaluation|rmse|select"),
    ]
    prose = tables["claims"].where("claim_id = 'prose'").first()
    assert prose["subject"] == "age" and prose["decision"] is None


def test_claims_without_a_key_are_found_with_each_line_parsed_once(spark):
    told = {"sure": "[1]", "prose": None, "none": "[]"}
    lines = spark.createDataFrame([("r", i, name, text) for i, (name, text) in enumerate(told.items())], "run_id string, line_no long, name string, e string")
    claim = F.concat(F.lit('{"claim_id":"'), "name", F.lit('","stage":"'), F.when(F.col("name") == "sure", "evaluation").otherwise("eda"),
                     F.lit('","primary_metric":"rmse","evidence":'), F.coalesce("e", F.lit("null")), F.lit("}"))
    lines = lines.select("run_id", "line_no", F.lit("claims.jsonl").alias("artifact"), claim.alias("value"), F.lit("d").alias("dataset"))
    lines = lines.unionByName(lines.withColumn("value", F.lit("no claim")))
    found = unkeyable(claims_with_keys(parse_lines(lines)[0]))
    assert sorted(r["record_key"] for r in found.collect()) == ["none", "prose"]
    one_side = claims_with_keys(parse_lines(lines)[0])
    steps = [f._jdf.queryExecution().optimizedPlan().toString().count("from_json(StructField(claim_id") for f in (one_side, found)]
    assert steps[0] == steps[1]


def test_every_rule_is_reported(tables, rows):
    got = tables["data_quality"].where("run_id = 'm9_bad_ab_t00_r1'")
    assert rows(got, "rule", "artifact", "record_key") == sorted([
        ("missing_required_file", "evidence_verdicts.jsonl", None),
        ("malformed_json", "claims.jsonl", "line:4"),
        ("orphan_claim_id", "claim_verdicts.jsonl", "ghost"),
        ("layer2_missing_eligible", "layer2_verdicts.jsonl", "drop_it"),
        ("layer2_ineligible_claim", "layer2_verdicts.jsonl", "refused"),
        ("unkeyable_claim", "claims.jsonl", "prose"),
    ], key=repr)
    other = tables["data_quality"].where("run_id = 'm9_mini_c_t07_r2'").collect()
    assert [(r["rule"], r["record_key"]) for r in other] == [("malformed_json", "line:3")]


def test_typed_values(tables, rows):
    assert rows(tables["evidence_refs"], "claim_id", "claimed_value_type", "claimed_value_json") == [
        ("e1", "bool", "true"), ("m1", "int", "12"), ("p1", "float", "15.0"), ("prose", "float", "0.2"),
        ("v1", "object", '{"a":null,"b":1}'),
    ]
    assert rows(tables["prompt_calls"].where("run_id like '%mini%'"), "call_index", "stage", "prompt_model") == [
        (0, "eda", "m-1"), (1, "critic_eda", "m-2"),
    ]
    run = tables["runs"].where("run_id like '%mini%'").first()
    assert (run["dataset"], run["arm"], run["temperature"], run["repeat"]) == ("mini", "c", 0.7, 2)
    assert run["manual_dataset_corrections_json"] == '[{"a":2,"z":1}]'
    metrics = {(r["run_id"][3:6], r["reported_arm"]): r for r in tables["run_metrics"].collect()}
    assert set(metrics) == {("min", "C"), ("bad", "A"), ("bad", "B")}
    assert metrics[("bad", "A")]["source_artifact"] == "arm_a_metrics.json"
    assert metrics[("min", "C")]["mean_layer2_score_eda"] == 3.0
    defect = tables["arm_c_defects"].first()
    assert (defect["observed_value"], defect["profile_value"], defect["profile_detected"]) == (0.99, 0.98, True)


def test_line_numbers_over_many_splits(spark, tmp_path):
    root = tmp_path / "runs"
    write(root / "m9_big_ab_t00_r1" / "claims.jsonl", *[{"n": i, "pad": "x" * 40} for i in range(5000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = run_source.artifact_lines(spark, str(root), "claims.jsonl").withColumn(
            "n", F.get_json_object("value", "$.n").cast("int")
        )
        assert lines.where("line_no = n + 1").count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_digest_goes_by_bytes_not_by_files(spark, tmp_path, monkeypatch):
    import hashlib

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    monkeypatch.setattr(run_source, "FAN_OUT", 3)
    lines = [f"line {i}\r" if i % 4 else "" for i in range(20)]
    run = tmp_path / "runs" / "m9_tree_c_t00_r1"
    write(run / "whole.txt", *lines)
    write(run / "open.txt", *lines)
    (run / "open.txt").write_bytes((run / "whole.txt").read_bytes()[:-1])
    write(run / "parts.txt" / "part-00000-x.txt", *lines[:7])
    write(run / "parts.txt" / "part-00001-x.txt", *lines[7:])
    write(run / "empty.txt")
    got = {r.artifact: r for r in run_source.artifact_digests(spark, str(tmp_path / "runs")).collect()}
    level = [sha(x) for x in lines]
    for _ in range(2):
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    size = (run / "whole.txt").stat().st_size
    assert got["whole.txt"].tree_sha256 == got["parts.txt"].tree_sha256 == sha(f"{size}:" + "".join(level))
    assert got["open.txt"].size_bytes == size - 1 and got["open.txt"].tree_sha256 != got["whole.txt"].tree_sha256
    assert got["whole.txt"].n_lines == 20 and "empty.txt" not in got


def test_any_line_end(spark, tmp_path, rows):
    run = tmp_path / "runs" / "m9_ends_c_t00_r1"
    write(run / "x.txt")
    (run / "x.txt").write_bytes(b"a\r\nb\rc\n\r\nd")
    found = run_source.artifact_lines(spark, str(tmp_path / "runs"), "x.txt")
    assert rows(found, "line_no", "value") == [(1, "a"), (2, "b"), (3, "c"), (4, ""), (5, "d")]


def test_stored_runs_stay(spark, tmp_path, rows):
    path = str(tmp_path / "kept")
    first = spark.createDataFrame([("a", 1), (None, 1)], "run_id string, load int")
    second = spark.createDataFrame([("a", 2), ("b", 2), ("b", 2), (None, 2)], "run_id string, load int")
    assert [backfill.append_summaries(spark, f, path, groups=2) for f in (first, second, second, first)] == [2, 1, 0, 0]
    assert rows(spark.read.parquet(path), "run_id", "load") == sorted([("a", 1), ("b", 2), (None, 1)], key=repr)


def test_export_bronze_silver_gold(spark, runs_dir, tmp_path):
    out, house = str(tmp_path / "export"), str(tmp_path / "house")
    manifest = {r["table_name"]: r["row_count"] for r in export.export_runs(spark, runs_dir, out).collect()}
    assert set(manifest) == set(TABLES) and manifest["claims"] == 7
    import hashlib
    from pathlib import Path

    hashes = {r["path"]: r for r in spark.read.parquet(f"{out}/source_files").collect()}
    path = "m9_mini_c_t07_r2/claims.jsonl"
    content = Path(runs_dir, path).read_bytes()
    assert hashes[path]["sha256"] == hashlib.sha256(content).hexdigest()
    assert hashes[path]["size_bytes"] == len(content)

    loaded = lakehouse.load_bronze(spark, out, house).collect()
    assert all(r["manifest_row_count"] == r["bronze_row_count"] for r in loaded)
    checks = lakehouse.load_silver(spark, house)
    assert checks.where("table_name <> 'claims_enriched'").count() == 4 * len(TABLES)
    failed = {(r["table_name"], r["check_type"]) for r in checks.where("status = 'FAIL'").collect()}
    assert failed == {
        ("data_quality", "null_keys"),
        ("claims_enriched", "eligible_missing_layer2"),
        ("claims_enriched", "ineligible_with_layer2"),
    }
    counts = lakehouse.load_gold(spark, house, "mini")
    assert counts["layer1_rates"] == 4 and counts["model_metrics"] == 1
    for name, grain in GRAINS.items():
        silver = spark.read.parquet(f"{house}/silver_{name}")
        assert silver.count() == silver.select(*grain).distinct().count()


def test_bronze_refuses_a_wrong_row_count(spark, tmp_path):
    out, house = tmp_path / "export", tmp_path / "house"
    spark.createDataFrame([], schema("runs")).write.parquet(str(out / "runs"))
    spark.createDataFrame([("runs", "runs", 3)], export.MANIFEST_SCHEMA).coalesce(1).write.json(str(out / "manifest"))
    with pytest.raises(RuntimeError, match="mismatch for runs"):
        lakehouse.load_bronze(spark, str(out), str(house))


def test_cast_failures_are_counted(spark, rows):
    frame = spark.createDataFrame([("r", "c", "3", "x"), ("r", "d", "bad", "0.5")],
                                  "run_id string, claim_id string, layer2_score string, critic_confidence string")
    frame = frame.withColumn("discrepancy_note", F.lit(""))
    assert rows(lakehouse.cast_failures(frame, "layer2_verdicts")) == [("critic_confidence", 1), ("layer2_score", 1)]


def test_secret_stops_the_export_before_any_output(spark, tmp_path):
    root, out = tmp_path / "runs", tmp_path / "out"
    write(root / "m9_tiny_ab_t00_r1" / "prompts.jsonl", "{}", {"credential": "sk-ant-" + "a1b2c3d4" * 3})
    with pytest.raises(RuntimeError, match=r"prompts.jsonl:2 \(anthropic_api_key\)") as caught:
        export.export_runs(spark, str(root), str(out))
    assert "a1b2c3d4" not in str(caught.value) and not out.exists()


@pytest.mark.parametrize(
    "line, names",
    [
        ("AKIA" + "A1" * 8, {"aws_access_key"}),
        ("akia" + "a1" * 8, set()),
        ("GHP_" + "a" * 20, {"github_token"}),
        ("-----begin rsa private key-----", {"private_key"}),
        ("bearer " + "z" * 20, {"bearer_token"}),
        ("api-key: " + "q" * 20, {"secret_assignment"}),
        ("API_KEY = '" + "q" * 20, {"secret_assignment"}),
        ("AIza" + "b" * 30, {"google_api_key"}),
        ("xoxb-" + "1" * 10, {"slack_token"}),
        ("eyJ" + ".".join(["a" * 12] * 3), {"jwt"}),
        ("sk-proj-" + "b" * 20, {"openai_api_key"}),
        ("the key to the token was a secret", set()),
    ],
)
def test_secret_patterns(spark, line, names):
    frame = spark.createDataFrame([(line,)], "value string")
    assert {r["pattern"] for r in secrets.scan_lines(frame, []).collect()} == names


def test_needles_are_necessary(spark):
    """Every pattern has needles, in lower case."""
    assert set(secrets.NEEDLES) == {name for name, _ in secrets.PATTERNS}
    assert all(n == n.lower() for needles in secrets.NEEDLES.values() for n in needles)


def test_backfill_is_idempotent(spark, tables, tmp_path):
    summaries = backfill.run_summaries(
        tables["runs"], tables["run_metrics"].drop("mean_layer2_score"), tables["prompt_calls"],
        tables["layer1_evidence_verdicts"], tables["layer2_verdicts"], tables["arm_c_defects"],
    )
    path = str(tmp_path / "summaries")
    assert backfill.append_summaries(spark, summaries, path) == 2
    assert backfill.append_summaries(spark, summaries, path) == 0
    stored = {r["run_id"]: r for r in spark.read.parquet(path).collect()}
    assert len(stored) == 2
    mini = stored["m9_mini_c_t07_r2"]
    assert (mini["agent_model"], mini["critic_model"], mini["arm_c_recall"], mini["override_rate"]) == ("m-1", "m-2", 1.0, 0.25)
    status = backfill.backfill_status(summaries, spark.read.parquet(path).limit(1)).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in status} == {"skipped": 1, "created": 1}


def test_bundles_are_ordered_json_lines(spark, tables, tmp_path):
    records = backfill.bundle_records({"layer2_verdicts": (tables["layer2_verdicts"], ["run_id", "claim_id"])})
    path = str(tmp_path / "bundles")
    backfill.write_bundles(records, path)
    lines = [json.loads(r["value"]) for r in spark.read.text(path).where("run_id like '%mini%'").collect()]
    assert sorted(x["claim_id"] for x in lines) == ["e1", "m1", "p1", "v1"]
    assert list(lines[0]) == sorted(lines[0])


def test_append_then_recompute(spark, tmp_path):
    from plumbline.plans import audit

    path = str(tmp_path / "verdicts")
    first = spark.createDataFrame([("a", "EVIDENCE_ACCURATE")], "claim_id string, layer1_code string")
    second = spark.createDataFrame([("a", "FABRICATED_EVIDENCE"), ("b", "EVIDENCE_ACCURATE")], "claim_id string, layer1_code string")
    claims = spark.createDataFrame([("a", "eda"), ("b", "eda")], "claim_id string, stage string")
    rates = []
    for batch in (first, second):
        backfill.append_rows(batch, path)
        stored = spark.read.text(path).select(F.from_json("value", "claim_id string, layer1_code string").alias("j")).select("j.*")
        rates.append(audit.audit_rates(audit.roll_up(claims, stored, ["claim_id"]), ["stage"]).first()["citation_fabrication_rate"])
    assert rates == [0.0, pytest.approx(1 / 3)]


def test_train_and_test_files(spark, tmp_path, rows):
    (tmp_path / "train.csv").write_text("39, State-gov, <=50K\n50, ?, >50K\n")
    (tmp_path / "test.csv").write_text("|a remark\n25,  Private , <=50K.\n?, Local, >50K.\n")
    frame = delimited.read_train_and_test(
        spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), "age int, work string, income string", "income"
    )
    assert rows(frame) == sorted([(39, "State-gov", "<=50K"), (50, None, ">50K"), (25, "Private", "<=50K"), (None, "Local", ">50K")], key=repr)


def test_separator_and_coercion(spark, tmp_path, rows):
    (tmp_path / "wine.csv").write_text('"a";"b,c";"d"\n1;x;2.5\n')
    path = str(tmp_path / "wine.csv")
    assert delimited.sniff_separator(spark, path) == ";"
    assert rows(delimited.read_csv(spark, path, sep=";")) == [(1, "x", 2.5)]
    text = spark.createDataFrame([("1.5",), ("abc",), (None,)], "age string")
    assert rows(delimited.coerce_numeric(text, ["age", "fare"])) == sorted([(1.5,), (None,), (None,)], key=repr)


def test_preflight(spark, rows):
    frame = spark.createDataFrame([("1", "u", 0.5), ("2", "v", None)], "code string, name string, y double")
    assert rows(delimited.preflight(frame, "y", "regression")) == [("code", "numeric-looking text"), ("y", "target has 1 missing values")]
    twice = frame.select("y", "y")
    assert delimited.preflight(twice, "y", "regression").first()["issue"] == "duplicate column names"


def test_lines_are_numbered_where_they_are_read(spark, tmp_path, rows, capsys):
    for part in range(3):
        write(tmp_path / "m9_mini_c_t00_r1" / "claims.jsonl" / f"part-{part}", *[f"{part}-{i}" for i in range(part + 2)])
    lines = run_source.artifact_lines(spark, str(tmp_path), "claims.jsonl")
    lines.explain()
    plan = capsys.readouterr().out
    assert "row_number" not in plan and "SortMergeJoin" not in plan
    assert rows(lines, "line_no", "value") == [
        (i + 1, v) for i, v in enumerate(f"{part}-{i}" for part in range(3) for i in range(part + 2))
    ]


def test_paths_are_placed_by_split_not_by_line(spark, tmp_path, rows, capsys):
    """Patterns over paths are for the one row of each split; only lines of the artifact of a run are numbered."""
    run = tmp_path / "m9_mini_c_t00_r1"
    write(run / "claims.jsonl" / "part-0", "a\rb", "c")
    write(run / "claims.jsonl" / "part-1", "d\r")
    write(run / "extra" / "claims.jsonl", "not one of ours")
    write(tmp_path / "notes" / "claims.jsonl", "no run")
    lines = run_source.artifact_lines(spark, str(tmp_path), "claims.jsonl")
    assert rows(lines, "run_id", "artifact", "line_no", "value") == [
        ("m9_mini_c_t00_r1", "claims.jsonl", i + 1, v) for i, v in enumerate("abcd")
    ]
    lines.explain()
    steps = capsys.readouterr().out.splitlines()
    by_line = [x for i, x in enumerate(steps) if not any("BroadcastExchange" in s for s in steps[:i])]
    by_line += steps[next(i for i, x in enumerate(steps) if "partial_count" in x):]
    assert by_line and not any("regexp_extract" in x for x in by_line)


def test_what_an_object_is_shows_at_its_first_character(spark, rows):
    texts = ['{"a":1}', ' \t\r{"a":1}', "[{}]", '"{"', "{", "1", "null", " {}", "   ", "{} "]
    lines = spark.createDataFrame([("r", "x.jsonl", i, t) for i, t in enumerate(texts)], "run_id string, artifact string, line_no long, value string")
    good, bad = parse_lines(lines)
    assert rows(good, "line_no") == [(0,), (1,), (9,)]
    assert rows(bad, "record_key", "message") == [
        (f"line:{i}", f"JSON line {i} is not an object" if i in (2, 3, 5, 6) else f"Could not parse JSON on line {i}") for i in range(2, 8)
    ]


def test_evidence_texts_are_for_nested_values_only(spark, rows):
    evidence = [[{"metric_key": "k", "claimed_value": 2.0}, "no object"], [{"claimed_value": 1}, {"claimed_value": {"b": [2.0], "a": 1}}], [{"x": 0}]]
    lines = [("r", "claims.jsonl", i, json.dumps({"claim_id": str(i), "evidence": e}), "d") for i, e in enumerate(evidence)]
    parsed = spark.createDataFrame(lines, "run_id string, artifact string, line_no long, value string, dataset string")
    keyed = claims_with_keys(parse_lines(parsed)[0])
    assert [r[0] is None for r in keyed.orderBy("line_no").select("_texts").collect()] == [True, False, True]
    assert rows(evidence_refs(keyed).drop("run_id", "metric_key")) == sorted([
        ("0", 0, "float", "2.0"), ("1", 0, "int", "1"), ("1", 1, "object", '{"a":1,"b":[2.0]}'), ("2", 0, "null", "null")], key=repr)


def test_export_keeps_nothing_in_memory(spark, runs_dir, tmp_path, rows):
    """References are checked in the written tables, so no claim stays behind in memory or on executors' disks."""
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    export.export_runs(spark, runs_dir, str(tmp_path / "export"))
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held
    written = spark.read.parquet(str(tmp_path / "export" / "data_quality"))
    assert ("orphan_claim_id", "ghost") in rows(written, "rule", "record_key")


def test_only_what_can_be_a_secret_is_searched(spark):
    """A line of a claim names metric keys; that alone does not send it through the patterns."""
    texts = [f"my {name} = '{'q' * 20}'" for name in ("apikey", "API-Key", "api_key", "Secret", "access_token", "accessToken", "access-token", "Authorization")]
    texts.append('{"metric_key":"n_rows","tokens":{"input":3},"claimed_value":"' + "q" * 20 + '"}')
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    assert {r["i"] for r in secrets.scan_lines(frame, ["i"]).where("pattern = 'secret_assignment'").collect()} == set(range(8))
    found = frame.select("i", secrets.found_patterns(F.col("value"), F.lower("value")).alias("found"))
    assert [r["i"] for r in found.where("found is null").collect()] == [8]


def test_claim_keys_are_not_sent_to_the_driver(spark, runs_dir, capsys):
    import re

    normalize_runs(read_artifacts(spark, runs_dir))["data_quality"].explain()
    plan = capsys.readouterr().out
    joins = re.findall(r"(\w+Join) \[run_id#\d+, claim_id#\d+\]", plan)
    assert len(joins) >= 4 and set(joins) == {"SortMergeJoin"}
