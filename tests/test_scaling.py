"""What queries do at size, told by their plans and calls."""

from pyspark.sql import functions as F

from plumbline.catalog import QUERIES
from plumbline.operators import corruption as cor
from plumbline.profile.associations import balance_rows


def written(spark, folder, name, rows, ddl):
    spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")


def test_defects_are_planted_by_the_operator(spark, tmp_path, monkeypatch, rows):
    written(spark, tmp_path, "orders", [(i, i % 9, None if i == 7 else 100.0 + i * i % 37) for i in range(50)], "o_orderkey bigint, o_custkey bigint, o_totalprice double")
    planted, plant = [], cor.plant_defects
    monkeypatch.setattr(cor, "plant_defects", lambda *args: planted.append(args[1:]) or plant(*args))
    got = rows(QUERIES["planted_identified"](spark, str(tmp_path)))
    assert planted == [("o_totalprice", "o_orderkey")]
    assert got == [("constant", "SYNTH_CONSTANT", 2, False), ("high_missing", "SYNTH_HIGH_MISSING", 1, True), ("leakage", "SYNTH_LEAKED", 1, True)]


def test_totals_of_few_groups_are_broadcast(spark):
    """Three groups hold all rows: joined by the group, a task would sort a third of them."""
    counts = spark.range(4_000_000).select((F.col("id") % 3).alias("entity"), F.col("id").alias("value"), F.lit(1).cast("bigint").alias("n"))
    counts = counts.groupBy("entity", "value").agg(F.sum("n").alias("n"))
    plan = balance_rows(counts)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rules_keep_no_parsed_evidence(spark, tmp_path):
    orders = [(i, i % 9, "F", 100.0) for i in range(50)]
    written(spark, tmp_path, "orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")
    found = QUERIES["dq_rules"](spark, str(tmp_path))
    kept = found._jdf.queryExecution().withCachedData().toString()
    kept = [line for line in kept.splitlines() if "InMemoryRelation" in line]
    assert kept and not any("_items" in line or "justification" in line for line in kept)
