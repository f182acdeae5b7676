"""Evidence audit: every cited metric value against the computed profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import count_where, ratio, within_tolerance
from plumbline.operators.joins import lookup

# Evidence codes.
ACCURATE = "EVIDENCE_ACCURATE"
MISSTATED = "EVIDENCE_MISSTATED"
FABRICATED = "FABRICATED_EVIDENCE"

# Metric names that decide a finding's severity.
CRITICAL_METRICS = (
    "leakage_suspect",
    "missingness_leakage_suspect",
    "is_constant",
    "target:is_imbalanced",
    "has_high_missing",
)
WARN_METRICS = (
    "is_multicollinear",
    "has_moderate_missing",
    "is_skewed",
    "missingness_informative",
)

NOTE_LENGTH = 300


def value_columns(prefix: str, **given: Column) -> list[Column]:
    """The typed value columns ``{prefix}_num|bool|str|map``; the ones not given are NULL."""
    types = {"num": "double", "bool": "boolean", "str": "string", "map": "map<string,double>"}
    return [
        given.get(kind, F.lit(None)).cast(sql_type).alias(f"{prefix}_{kind}")
        for kind, sql_type in types.items()
    ]


def maps_match(real: Column, claimed: Column) -> Column:
    """Same key set and every value within tolerance."""
    same_size = F.size(real) == F.size(claimed)
    each = F.forall(
        F.map_entries(real),
        lambda e: F.coalesce(within_tolerance(e["value"], F.element_at(claimed, e["key"])), F.lit(False)),
    )
    return same_size & each


def verdict_code() -> Column:
    """The evidence rules over ``found``, ``real_*`` and ``claimed_*`` columns, in rule order."""
    r_num, r_bool, r_str, r_map = (F.col(f"real_{k}") for k in ("num", "bool", "str", "map"))
    c_num, c_bool, c_str, c_map = (F.col(f"claimed_{k}") for k in ("num", "bool", "str", "map"))
    real_null = r_num.isNull() & r_bool.isNull() & r_str.isNull() & r_map.isNull()
    claimed_null = c_num.isNull() & c_bool.isNull() & c_str.isNull() & c_map.isNull()
    match = (
        F.when(r_map.isNotNull(), c_map.isNotNull() & maps_match(r_map, c_map))
        .when(r_num.isNotNull(), within_tolerance(r_num, c_num))
        .when(r_bool.isNotNull(), r_bool == c_bool)
        .otherwise(r_str == c_str)
    )
    return (
        F.when(F.col("found").isNull(), FABRICATED)
        .when(real_null & claimed_null, ACCURATE)
        .when(real_null, FABRICATED)
        .when(F.coalesce(match, F.lit(False)), ACCURATE)
        .otherwise(MISSTATED)
    )


def split_subkey(metric_key: Column) -> tuple[Column, Column]:
    """``balance[A]`` as (``balance``, ``A``); other keys as (key, NULL)."""
    pattern = r"^(.+)\[([^\[\]]+)\]$"
    found = metric_key.rlike(pattern)
    return (
        F.when(found, F.regexp_extract(metric_key, pattern, 1)).otherwise(metric_key),
        F.when(found, F.regexp_extract(metric_key, pattern, 2)),
    )


def resolve(evidence: DataFrame, profile: DataFrame, keys: Sequence[str] = ("metric_key",)) -> DataFrame:
    """Evidence with the real value of its key; ``found`` tells a NULL value from no such key."""
    return lookup(evidence, profile.withColumn("found", F.lit(True)), keys)


def citable(profile: DataFrame, keys: Sequence[str] = ("metric_key",)) -> DataFrame:
    """Every key a claim may cite, once: the profile's own, and ``parent[sub]`` for each entry of a map.

    Where both give the same key, the one that exists as written wins. Entries whose name can't be cited (empty, or
    with a bracket) are left out.
    """
    values = value_columns("real", **{kind: F.col(f"real_{kind}") for kind in ("num", "bool", "str", "map")})
    own = profile.select(*keys, *values, F.lit(0).alias("_rank"))
    entries = profile.where(F.col("real_map").isNotNull()).select(*keys, F.explode("real_map").alias("_sub", "_value"))
    cited = F.concat(F.col("metric_key"), F.lit("["), F.col("_sub"), F.lit("]"))
    parent, sub = split_subkey(cited)
    listed = entries.where((parent == F.col("metric_key")) & (sub == F.col("_sub"))).withColumn("metric_key", cited)
    listed = listed.select(*keys, *value_columns("real", num=F.col("_value")), F.lit(1).alias("_rank"))
    names = [f"real_{kind}" for kind in ("num", "bool", "str", "map")]
    first = own.unionByName(listed).groupBy(*keys).agg(F.min_by(F.struct(*names), "_rank").alias("_first"))
    return first.select(*keys, "_first.*")


def resolve_with_subkeys(
    evidence: DataFrame, profile: DataFrame, keys: Sequence[str] = ("metric_key",)
) -> DataFrame:
    """As ``resolve``; a key that exists as written wins, else ``parent[sub]`` is looked up: one join for both."""
    return resolve(evidence, citable(profile, keys), keys)


def map_verdicts(claimed: DataFrame, real: DataFrame, keys: Sequence[str] = ("metric_key",)) -> DataFrame:
    """One code per claimed map, of maps kept as rows (keys, ``sub_key``, ``value``), with any number of entries.

    Per map: ``claimed_entries``, ``real_entries``, ``matched_entries`` and ``layer1_code``. A map is right when both
    sides name the same entries and each value is within tolerance; NULL names an entry like any other, a NULL value
    matches nothing. Claimed maps without a real one are invented; real maps that nobody claims are left out. An
    entry that repeats on one side makes the map wrong. Entries meet by aggregation, so a map of most rows is spread
    over its entries, and only counts meet at its key.
    """
    none = F.lit(None).cast("double")
    value = F.col("value").cast("double")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sides = claimed.select(*keys, "sub_key", value.alias("_c"), none.alias("_r"), one.alias("_nc"), zero.alias("_nr"))
    sides = sides.unionByName(
        real.select(*keys, "sub_key", none.alias("_c"), value.alias("_r"), zero.alias("_nc"), one.alias("_nr"))
    )
    entries = sides.groupBy(*keys, "sub_key").agg(*[f(c).alias(c) for f, c in ((F.max, "_c"), (F.max, "_r"), (F.sum, "_nc"), (F.sum, "_nr"))])
    same = (F.col("_nc") == 1) & (F.col("_nr") == 1) & F.coalesce(within_tolerance(F.col("_r"), F.col("_c")), F.lit(False))
    counted = entries.groupBy(*keys).agg(
        F.sum("_nc").alias("claimed_entries"),
        F.sum("_nr").alias("real_entries"),
        count_where(same).alias("matched_entries"),
        count_where(~same).alias("_wrong"),
    )
    code = F.when(F.col("real_entries") == 0, FABRICATED).when(F.col("_wrong") == 0, ACCURATE).otherwise(MISSTATED)
    return counted.where("claimed_entries > 0").withColumn("layer1_code", code).drop("_wrong")


def verdicts(resolved: DataFrame) -> DataFrame:
    drop = [f"{side}_{k}" for side in ("real", "claimed") for k in ("num", "bool", "str", "map")]
    return resolved.withColumn("layer1_code", verdict_code()).drop("found", *drop)


def citation_counts(evidence_verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by code per claim; combined before the shuffle, so a hot claim is one row per task."""
    code = F.col("layer1_code")
    return evidence_verdicts.groupBy(*keys).agg(
        F.count("*").alias("citations"),
        count_where(code == ACCURATE).alias("accurate"),
        count_where(code == MISSTATED).alias("misstated"),
        count_where(code == FABRICATED).alias("fabricated"),
    )


def roll_up(claims: DataFrame, evidence_verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One code per claim: worst citation wins, no citations counts as accurate."""
    counts = citation_counts(evidence_verdicts, keys)
    joined = claims.join(counts, list(keys), "left").fillna(
        0, ["citations", "accurate", "misstated", "fabricated"]
    )
    code = (
        F.when(F.col("fabricated") > 0, FABRICATED)
        .when(F.col("misstated") > 0, MISSTATED)
        .otherwise(ACCURATE)
    )
    return joined.withColumn("claim_layer1_code", code)


def citation_code_chunks(
    evidence_verdicts: DataFrame, keys: Sequence[str], index: str = "evidence_index", chunk: int = 1024
) -> DataFrame:
    """Citation codes in citation order, in arrays of at most ``chunk`` (chunk 0 is the usual one)."""
    return (
        evidence_verdicts.withColumn("chunk", (F.col(index) / chunk).cast("bigint"))
        .groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_list(F.struct(index, "layer1_code"))).alias("_codes"))
        .select(*keys, "chunk", F.col("_codes.layer1_code").alias("citation_layer1_codes"))
    )


def audit_rates(rolled: DataFrame, by: Sequence[str]) -> DataFrame:
    """Citation- and claim-level rates; NULL when there is nothing to divide by."""
    code = F.col("claim_layer1_code")
    totals = rolled.groupBy(*by).agg(
        F.sum("citations").alias("total_citations"),
        F.count("*").alias("total_claims"),
        F.sum("fabricated").alias("_cf"),
        F.sum("misstated").alias("_cm"),
        count_where(code == FABRICATED).alias("_kf"),
        count_where(code == MISSTATED).alias("_km"),
    )
    return totals.select(
        *by,
        "total_citations",
        "total_claims",
        ratio(F.col("_cf"), F.col("total_citations")).alias("citation_fabrication_rate"),
        ratio(F.col("_cm"), F.col("total_citations")).alias("citation_misstatement_rate"),
        ratio(F.col("_kf"), F.col("total_claims")).alias("claim_fabrication_rate"),
        ratio(F.col("_km"), F.col("total_claims")).alias("claim_misstatement_rate"),
    )


def invalid_keys(evidence: DataFrame, profile: DataFrame, keys: Sequence[str] = ("metric_key",)) -> DataFrame:
    """Distinct cited keys that resolve to nothing."""
    return evidence.select(*keys).distinct().join(profile.select(*keys), list(keys), "left_anti")


def claim_context(evidence: DataFrame, profile: DataFrame, claim_keys: Sequence[str]) -> DataFrame:
    """Per claim, a map of the cited profile entries only.

    Repeated citations collapse first, so a map holds at most one entry per metric of the profile.
    """
    cited = evidence.select(*claim_keys, "metric_key").distinct()
    found = cited.join(profile.select("metric_key", "value"), "metric_key", "inner")
    entries = F.sort_array(F.collect_list(F.struct("metric_key", "value")))
    return found.groupBy(*claim_keys).agg(F.map_from_entries(entries).alias("context"))


def rule_name(metric_key: Column) -> Column:
    """Last segment of a metric key; the imbalance flag keeps its full name."""
    last = F.element_at(F.split(metric_key, ":"), -1)
    return F.when(metric_key == "target:is_imbalanced", metric_key).otherwise(last)


def derived_severity(claims: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Severity from the flags a claim cites as TRUE: critical before warn, else info."""
    name = rule_name(F.col("metric_key"))
    rank = F.when(name.isin(*CRITICAL_METRICS), 2).when(name.isin(*WARN_METRICS), 1).otherwise(0)
    ranks = (
        evidence.where(F.col("claimed_bool"))
        .groupBy(*keys)
        .agg(F.max(rank).alias("_rank"))
    )
    severity = F.when(F.col("_rank") == 2, "critical").when(F.col("_rank") == 1, "warn").otherwise("info")
    return (
        claims.join(ranks, list(keys), "left")
        .withColumn("rule_derived_severity", severity)
        .drop("_rank")
    )


def annotate_severity(derived: DataFrame) -> DataFrame:
    """The derived severity replaces the stated one; a difference is a violation."""
    return derived.withColumn(
        "severity_rule_violation", F.col("llm_stated_severity") != F.col("rule_derived_severity")
    ).withColumn("severity", F.col("rule_derived_severity"))


def eligible(rolled: DataFrame) -> DataFrame:
    """Only claims whose evidence is accurate are scored."""
    return rolled.where(F.col("claim_layer1_code") == ACCURATE)


def critic_note(score: Column, note: Column) -> Column:
    """No note on a full score, else at most the stored note length."""
    return F.when(score == 3, F.lit("")).otherwise(F.substring(note, 1, NOTE_LENGTH))


def layer2_metrics(claims: DataFrame, scores: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Score means per group of claims; a group without scores is present with NULLs."""
    joined = claims.join(scores, list(keys), "left")
    s = F.col("layer2_score")
    return joined.groupBy(*by).agg(
        F.count(s).alias("layer2_claims_scored"),
        F.avg(s).alias("mean_layer2_score"),
        F.avg(F.when(s.isNotNull(), (s == 0).cast("double"))).alias("mischaracterization_rate"),
        F.avg(F.when(s.isNotNull(), (s == 1).cast("double"))).alias("wrong_direction_rate"),
    )


def rescore_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Rows whose value changed between two snapshots, and whether only allowed columns changed."""
    others = [c for c in before.columns if c not in keys]
    renamed = after.select(*keys, *[F.col(c).alias(f"new_{c}") for c in others])
    joined = before.join(renamed, list(keys), "inner")
    changed = {c: ~F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in others}
    any_change, bad_change = F.lit(False), F.lit(False)
    for column, test in changed.items():
        any_change = any_change | test
        if column not in allowed:
            bad_change = bad_change | test
    return joined.where(any_change).withColumn("unexpected_change", bad_change)


def allowed_evidence(profile: DataFrame, retained: DataFrame) -> DataFrame:
    """Profile rows a later stage may cite: no column count, only retained columns."""
    dataset_level = profile.where(F.col("column_name").isNull() & (F.col("metric_key") != "n_cols"))
    kept = profile.where(F.col("column_name").isNotNull()).join(
        retained.select("column_name"), "column_name", "left_semi"
    )
    return dataset_level.select("metric_key").unionByName(kept.select("metric_key"))
