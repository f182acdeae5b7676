"""Profiler queries.

The profiled dataset is ``lineitem`` with values removed by a rule on its keys, a copied column and
a small numeric target; ``orders`` serves for identifiers and class targets.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import functions as F

from plumbline.catalog.registry import query, sql_normal, table
from plumbline.operators import corruption as cor
from plumbline.plans import audit
from plumbline.profile import associations as assoc
from plumbline.profile import dataset as ds
from plumbline.profile import univariate as uni
from plumbline.profile.columns import classify, normalize
from plumbline.session import shared_dir

NUMERIC = ("quantity", "price", "discount", "tax", "linenumber", "copied")
CATEGORICAL = ("flag", "status")
TARGET = "tax"
ORDER = ("quantity", "price", "discount", "tax", "linenumber", "flag", "status", "copied")


def lines(spark, sf):
    gap = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17) % 100
    price_gap = (F.col("l_orderkey") * 13 + F.col("l_partkey") * 7 + F.col("l_linenumber")) % 100
    return (
        table(spark, sf, "lineitem")
        .withColumns({"_gap": gap, "_pgap": price_gap})
        .select(
            F.expr("case when _gap >= 12 then l_quantity end").alias("quantity"),
            F.expr("case when _pgap >= 45 then l_extendedprice end").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_linenumber").alias("linenumber"),
            F.expr("case when _gap >= 6 then l_returnflag end").alias("flag"),
            F.col("l_linestatus").alias("status"),
            F.expr("case when _gap >= 12 then l_quantity end").alias("copied"),
        )
    )


GAP = "(l_orderkey * 31 + l_partkey * 17) % 100"
PRICE_GAP = "(l_orderkey * 13 + l_partkey * 7 + l_linenumber) % 100"
LINES = f"""lines as (select case when {GAP} >= 12 then l_quantity end as quantity,
  case when {PRICE_GAP} >= 45 then l_extendedprice end as price, l_discount as discount,
  l_tax as tax, l_linenumber as linenumber, case when {GAP} >= 6 then l_returnflag end as flag, l_linestatus as status,
  case when {GAP} >= 12 then l_quantity end as copied from lineitem)"""


def per_column(template: str, names) -> str:
    return " union all ".join(template.replace("{c}", c) for c in names)


def rounded(frame, digits=6):
    return frame.select(
        *[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
          for f in frame.schema.fields]
    )


NUMERIC_SQL = per_column(
    """select '{c}' as column_name, count(*) as n_rows, count({c}) as n, round(avg({c}), 7) as mean,
  round(stddev_samp({c}), 7) as std, round(cast(min({c}) as double), 7) as min,
  round(cast(max({c}) as double), 7) as max from lines""",
    NUMERIC,
)


@query("prof_numeric", f"with {LINES} {NUMERIC_SQL}")
def prof_numeric(spark, sf):
    frame = normalize(lines(spark, sf).select(*NUMERIC))
    return rounded(uni.moments(frame, classify(frame)).drop("skew", "kurtosis", "is_whole"), 7)


@query(
    "prof_shape",
    f"with {LINES} "
    + per_column(
        """select '{c}' as column_name, round(skewness({c}), 6) as skew, round(kurtosis({c}), 6) as kurtosis,
  abs(skewness({c})) > 1 as is_skewed from lines""",
        NUMERIC,
    ),
)
def prof_shape(spark, sf):
    frame = normalize(lines(spark, sf).select(*NUMERIC))
    shape = uni.moments(frame, classify(frame)).select(
        "column_name", "skew", "kurtosis", (F.abs("skew") > 1.0).alias("is_skewed")
    )
    return rounded(shape)


SPREAD_SQL = """select '{c}' as column_name, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
  case when q1 = q3 and z > 0.5 then null when q1 = q3 then 0 else round(100e0 *
    (select count(*) from lines where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) / n, 2) end
    as iqr_outlier_pct,
  q1 = q3 and z > 0.5 as is_zero_inflated, round((1 - z) * 100, 2) as nonzero_pct
from (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as median, quantile_cont({c}, 0.75) as q3,
  count({c}) as n, avg(case when {c} is not null then ({c} = 0)::int end) as z from lines)"""


@query("prof_quartiles_outliers", f"with {LINES} " + per_column(SPREAD_SQL, NUMERIC))
def prof_quartiles_outliers(spark, sf):
    frame = normalize(lines(spark, sf).select(*NUMERIC))
    columns = classify(frame)
    return rounded(uni.outlier_profile(uni.spread(uni.numeric_values(frame, columns))))


@query(
    "prof_missing",
    f"with {LINES} "
    + per_column(
        """select '{c}' as column_name, round(100e0 * count(*) filter ({c} is null) / count(*), 2) as missing_pct,
  count({c}) < count(*) as has_missing,
  round(100e0 * count(*) filter ({c} is null) / count(*), 2) > 40 as has_high_missing,
  round(100e0 * count(*) filter ({c} is null) / count(*), 2) > 5
    and round(100e0 * count(*) filter ({c} is null) / count(*), 2) <= 40 as has_moderate_missing from lines""",
        NUMERIC + CATEGORICAL,
    ),
)
def prof_missing(spark, sf):
    frame = normalize(lines(spark, sf))
    counts = uni.moments(frame, classify(frame)).select("column_name", "n_rows", "n")
    pct = F.round(F.try_divide((F.col("n_rows") - F.col("n")).cast("double"), F.col("n_rows")) * 100.0, 2)
    return counts.select(
        "column_name",
        pct.alias("missing_pct"),
        (F.col("n") < F.col("n_rows")).alias("has_missing"),
        (pct > 40.0).alias("has_high_missing"),
        ((pct > 5.0) & (pct <= 40.0)).alias("has_moderate_missing"),
    )


@query(
    "prof_categorical",
    f"with {LINES}, o as (select c_name, c_mktsegment from customer) "
    + per_column(
        """select '{c}' as column_name, (select count(distinct {c}) from lines) as nunique,
  round(100e0 * max(n) / sum(n), 2) as top_category_pct, (select count(distinct {c}) from lines) > 15
    as is_high_cardinality from (select {c}, count(*) as n from lines where {c} is not null group by 1)""",
        CATEGORICAL,
    )
    + " union all "
    + per_column(
        """select '{c}', (select count(distinct {c}) from o), round(100e0 * max(n) / sum(n), 2),
  (select count(distinct {c}) from o) > 15 from (select {c}, count(*) as n from o where {c} is not null group by 1)""",
        ("c_name", "c_mktsegment"),
    ),
)
def prof_categorical(spark, sf):
    parts = []
    for frame in (lines(spark, sf).select(*CATEGORICAL), table(spark, sf, "customer").select("c_name", "c_mktsegment")):
        frame = normalize(frame)
        parts.append(uni.frequency_summary(uni.value_frequencies(frame, classify(frame))))
    return uni.union_all(parts).select(
        "column_name",
        "nunique",
        F.round(F.col("top_n") / F.col("n") * 100.0, 2).alias("top_category_pct"),
        (F.col("nunique") > 15).alias("is_high_cardinality"),
    )


IDENTIFIERS = ("o_orderkey", "o_custkey", "o_orderstatus", "half", "o_totalprice")
ORDERS = "o as (select o_orderkey, o_custkey, o_orderstatus, o_orderkey * 0.5e0 as half, o_totalprice from orders)"


def order_frame(spark, sf):
    return normalize(
        table(spark, sf, "orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_orderkey") * 0.5).alias("half"), "o_totalprice"
        )
    )


@query(
    "prof_identifier",
    f"with {ORDERS} "
    + per_column(
        """select '{c}' as column_name, count(distinct {c}) as nunique, count(distinct {c}) <= 1 as is_constant,
  count(distinct {c}) * 1e0 / count(*) > 0.95 and coalesce(bool_and(try_cast({c} as double) % 1 = 0),
    '{c}' = 'o_orderstatus') as is_id_like from o""",
        IDENTIFIERS,
    ),
)
def prof_identifier(spark, sf):
    frame = order_frame(spark, sf)
    columns = classify(frame)
    shape = uni.moments(frame, columns).select("column_name", "n_rows", "is_whole")
    distinct = uni.frequency_summary(uni.value_frequencies(frame, columns)).select("column_name", "nunique")
    unique = F.col("nunique") / F.col("n_rows") > ds.ID_UNIQUENESS
    return (
        shape.join(distinct, "column_name")
        .select(
            "column_name",
            "nunique",
            (F.col("nunique") <= 1).alias("is_constant"),
            (unique & (F.col("is_whole") | F.col("column_name").isin(*columns.categorical))).alias("is_id_like"),
        )
    )


SEQUENCE_SQL = """select '{c}' as column_name, k >= 3 and whole and lo = hi and lo > 0 as is_sequential from (
  select count(*) as k, bool_and(v % 1 = 0) as whole, min(gap) as lo, max(gap) as hi from (
    select v, v - lag(v) over (order by v) as gap from (select distinct {c} as v from {t} where {c} is not null)))"""


@query(
    "prof_sequential",
    f"with {LINES}, {ORDERS} "
    + per_column(SEQUENCE_SQL.replace("{t}", "o"), ("o_orderkey", "o_custkey", "half", "o_totalprice"))
    + " union all "
    + per_column(SEQUENCE_SQL.replace("{t}", "lines"), ("linenumber", "quantity", "tax")),
)
def prof_sequential(spark, sf):
    parts = []
    for frame in (
        order_frame(spark, sf).drop("o_orderstatus"),
        normalize(lines(spark, sf).select("linenumber", "quantity", "tax")),
    ):
        parts.append(uni.sequential(uni.value_frequencies(frame, classify(frame))))
    return uni.union_all(parts)


@query(
    "prof_target_balance",
    f"""with {LINES} select flag as value, round(count(*) / (sum(count(*)) over () * 1e0), 4) as share
from lines group by 1""",
)
def prof_target_balance(spark, sf):
    return assoc.class_balance(assoc.class_counts(lines(spark, sf), "flag"))


@query(
    "prof_imbalance",
    f"with {LINES}, docs as (select toxic, quality from labels) "
    + " union all ".join(
        f"""select '{c}' as target, case when count(*) = 0 then null when count(*) = 2 then min(n) / (sum(n) * 1e0) < 0.2
  else min(n) / (sum(n) * 1e0) < 0.05 end as is_imbalanced
from (select {c}, count(*) as n from {t} where {c} is not null group by 1)"""
        for t, c in (("lines", "flag"), ("lines", "status"), ("lines", "tax"), ("docs", "toxic"), ("docs", "quality"))
    ),
)
def prof_imbalance(spark, sf):
    parts = []
    for frame, names in (
        (lines(spark, sf), ("flag", "status", "tax")),
        (table(spark, sf, "labels"), ("toxic", "quality")),
    ):
        for name in names:
            flag = assoc.is_imbalanced(assoc.class_counts(frame, name))
            parts.append(flag.select(F.lit(name).alias("target"), "is_imbalanced"))
    return uni.union_all(parts)


@query(
    "prof_duplicate_rows",
    """select count(*) as distinct_rows, cast(sum(n) as bigint) as n_rows, cast(sum(n - 1) as bigint) as n_duplicated_rows
from (select p_brand, p_type, p_size, count(*) as n from part group by 1, 2, 3)""",
)
def prof_duplicate_rows(spark, sf):
    return ds.duplicate_rows(table(spark, sf, "part").select("p_brand", "p_type", "p_size")).select("distinct_rows", "n_rows", "n_duplicated_rows")


OTHERS = tuple(c for c in NUMERIC if c != TARGET)


@query(
    "prof_pearson_target",
    f"with {LINES} "
    + per_column(
        f"""select '{{c}}' as column_name, round(corr({{c}}, {TARGET}), 6) as corr_with_target,
  abs(corr({{c}}, {TARGET})) > 0.95 as leakage_suspect from lines""",
        OTHERS,
    ),
)
def prof_pearson_target(spark, sf):
    pearson = assoc.target_pearson(normalize(lines(spark, sf)), OTHERS, TARGET)
    return pearson.select(
        "column_name",
        F.round("association", 6).alias("corr_with_target"),
        (F.abs("association") > ds.LEAKAGE).alias("leakage_suspect"),
    )


def cramers_sql(source: str, column: str, target: str) -> str:
    return f"""(select sqrt(greatest(0, phi2 - (c - 1) * (r - 1) / (n - 1)) /
    least(c - (c - 1) * (c - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1))
  from (select sum(nij * 1e0 * nij / (ri * 1e0 * cj)) - 1 as phi2, sum(nij) * 1e0 as n,
      count(distinct v) * 1e0 as r, count(distinct t) * 1e0 as c
    from (select v, t, nij, sum(nij) over (partition by v) as ri, sum(nij) over (partition by t) as cj
      from (select {column} as v, {target} as t, count(*) as nij from {source}
        where {column} is not null and {target} is not null group by 1, 2))))"""


CRAMERS = ("quantity", "linenumber", "status", "discount")


@query(
    "prof_cramers",
    f"with {LINES} "
    + " union all ".join(
        f"select '{c}' as column_name, round({cramers_sql('lines', c, 'flag')}, 6) as corr_with_target" for c in CRAMERS
    ),
)
def prof_cramers(spark, sf):
    """A string target: every column counts as categories."""
    frame = normalize(lines(spark, sf))
    cells = assoc.contingency(frame, CRAMERS, "flag", classify(frame))
    return assoc.cramers_v(cells).select("column_name", F.round("association", 6).alias("corr_with_target"))


@query(
    "prof_corr_matrix",
    f"with {LINES} "
    + " union all ".join(
        f"select '{a}' as left_name, '{b}' as right_name, round(corr({a}, {b}), 6) as correlation from lines"
        for a, b in combinations(NUMERIC, 2)
    ),
)
def prof_corr_matrix(spark, sf):
    frame = normalize(lines(spark, sf).select(*NUMERIC))
    return rounded(assoc.pair_correlations(frame, NUMERIC, uni.means(frame, NUMERIC)))


GAPPY = ("quantity", "price", "flag", "copied")


@query(
    "prof_missing_cluster",
    f"with {LINES}, p as ("
    + " union all ".join(
        f"select '{a}' as column_name, abs(corr(({a} is null)::int, ({b} is null)::int)) as r from lines"
        for a, b in permutations(GAPPY, 2)
    )
    + ") select column_name, round(max(r), 6) as missingness_cluster_corr_max from p group by 1",
)
def prof_missing_cluster(spark, sf):
    indicators = assoc.missing_indicators(lines(spark, sf), GAPPY)
    strongest = assoc.strongest(assoc.pair_correlations(indicators, GAPPY))
    return strongest.select("column_name", F.round("strongest", 6).alias("missingness_cluster_corr_max"))


@query(
    "prof_missing_target",
    f"with {LINES}, m as ("
    + " union all ".join(
        f"select '{c}' as column_name, corr(({c} is null)::int, {TARGET}) as r from lines" for c in GAPPY
    )
    + """) select column_name, round(r, 6) as missingness_target_corr, abs(r) > 0.3 as missingness_informative,
  abs(r) > 0.7 as missingness_leakage_suspect from m""",
)
def prof_missing_target(spark, sf):
    r = assoc.target_pearson(normalize(lines(spark, sf)), GAPPY, TARGET, missing=True)
    return r.select(
        "column_name",
        F.round("association", 6).alias("missingness_target_corr"),
        (F.abs("association") > ds.INFORMATIVE_MISSING).alias("missingness_informative"),
        (F.abs("association") > ds.LEAKING_MISSING).alias("missingness_leakage_suspect"),
    )


MISSING_CRAMERS = ("quantity", "price", "copied")


@query(
    "prof_missing_cramers",
    f"with {LINES} "
    + " union all ".join(
        f"select '{c}' as column_name, round({cramers_sql('lines', f'({c} is null)', 'flag')}, 6) as missingness_target_corr"
        for c in MISSING_CRAMERS
    ),
)
def prof_missing_cramers(spark, sf):
    """Missing indicators against a string target."""
    frame = normalize(lines(spark, sf))
    cells = assoc.missing_contingency(frame, MISSING_CRAMERS, "flag", classify(frame))
    return assoc.cramers_v(cells).select("column_name", F.round("association", 6).alias("missingness_target_corr"))


@query(
    "prof_duplicate_columns",
    f"with {LINES}, p as ("
    + " union all ".join(
        f"""select '{a}' as column_name, '{b}' as duplicate_of, {NUMERIC.index(b)} as o,
  count(*) filter ({a} is distinct from {b}) = 0 or (corr({a}, {b}) > 0.999
    and abs(min(case when {b} is not null then {a} end) - min(case when {a} is not null then {b} end)) <= 1e-8
      + 1e-3 * abs(min(case when {a} is not null then {b} end))
    and abs(max(case when {b} is not null then {a} end) - max(case when {a} is not null then {b} end)) <= 1e-8
      + 1e-3 * abs(max(case when {a} is not null then {b} end))) as d from lines"""
        for a, b in permutations(NUMERIC, 2)
    )
    + ") select column_name, min_by(duplicate_of, o) as duplicate_of from p where d group by 1",
)
def prof_duplicate_columns(spark, sf):
    frame = normalize(lines(spark, sf).select(*NUMERIC))
    pairs = assoc.pair_correlations(frame, NUMERIC, uni.means(frame, NUMERIC)).collect()
    found = ds.duplicate_columns(frame, classify(frame), pairs)
    return spark.createDataFrame(list(found.items()), "column_name string, duplicate_of string")


VIF_COLUMNS = ("quantity", "price", "discount")


@query(
    "prof_vif",
    f"""with {LINES}, med as (select quantile_cont(quantity, 0.5) as mq, quantile_cont(price, 0.5) as mp from lines),
f as (select coalesce(quantity, mq) as a, coalesce(price, mp) as b, discount as c from lines, med),
r as (select corr(a, b) as ab, corr(a, c) as ac, corr(b, c) as bc from f),
d as (select *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc as det from r)
select 'quantity' as column_name, round((1 - bc * bc) / det, 6) as vif, (1 - bc * bc) / det > 10 as is_multicollinear from d
union all select 'price', round((1 - ac * ac) / det, 6), (1 - ac * ac) / det > 10 from d
union all select 'discount', round((1 - ab * ab) / det, 6), (1 - ab * ab) / det > 10 from d""",
)
def prof_vif(spark, sf):
    frame = normalize(lines(spark, sf).select(*VIF_COLUMNS))
    columns = classify(frame)
    stats = {c: {"mean": m} for c, m in uni.means(frame, VIF_COLUMNS).items()}
    medians = uni.exact_quantiles(uni.numeric_values(frame, columns), (0.5,))
    for row in medians.collect():
        stats[row["column_name"]]["median"] = row["quantile"]
    factors = ds.inflation_factors(frame, VIF_COLUMNS, stats)
    return rounded(
        spark.createDataFrame(
            [(c, v, v is not None and v > ds.MULTICOLLINEAR_VIF) for c, v in factors.items()],
            "column_name string, vif double, is_multicollinear boolean",
        )
    )


def stats_sql() -> str:
    """One row of statistics per column of the line frame with a numeric target."""
    parts = []
    for c in (*NUMERIC, *CATEGORICAL):
        number = c in NUMERIC
        fractional = f"({c} % 1 = 0)" if number else "false"
        if c == TARGET:
            corr = "null::double"
        elif number:
            corr = f"(select corr({c}, {TARGET}) from lines)"
        else:
            corr = cramers_sql("lines", c, TARGET)
        missing_corr = (
            f"(select corr(({c} is null)::int, {TARGET}) from lines)" if c in GAPPY else "null::double"
        )
        skew = f"(select skewness({c}) from lines)" if number else "null::double"
        sequence = (
            f"(select is_sequential from ({SEQUENCE_SQL.replace('{c}', c).replace('{t}', 'lines')}))"
            if number
            else "false"
        )
        variation = (
            f"(select stddev_samp({c}) / (abs(avg({c})) + 1e-8) from lines)" if number else "null::double"
        )
        zero = (
            f"(select is_zero_inflated from ({SPREAD_SQL.replace('{c}', c)}))" if number else "false"
        )
        top = (
            "null::double"
            if number
            else f"(select round(100e0 * max(m) / sum(m), 2) from (select count(*) as m from lines where {c} is not null group by {c}))"
        )
        outliers = f"(select iqr_outlier_pct from ({SPREAD_SQL.replace('{c}', c)}))" if number else "null::double"
        duplicate = {"quantity": "'copied'", "copied": "'quantity'"}.get(c, "null")
        parts.append(
            f"""select '{c}' as c, {str(number).lower()} as num, count(*) as n_rows, count({c}) as n,
  count(distinct {c}) as k, coalesce(bool_and({fractional}) filter ({c} is not null), false) as whole,
  {corr} as corr, {missing_corr} as mcorr, {skew} as skew, {sequence} as seq, {variation} as cv, {zero} as zero,
  {duplicate} as dup, '{c}' = '{TARGET}' as target, {top} as top, {outliers} as outliers, {ORDER.index(c)} as ordinal
from lines"""
        )
    return " union all ".join(parts)


def long_sql() -> str:
    """All flags of the line frame, metric by metric."""
    flags = {
        "has_missing": "n < n_rows",
        "is_sequential": "seq",
        "is_high_cardinality": "not num and k > 15",
        "is_constant": "k <= 1",
        "is_id_like": "k / (n_rows * 1e0) > 0.95 and (whole or not num)",
        "has_high_missing": "round(100e0 * (n_rows - n) / n_rows, 2) > 40",
        "has_moderate_missing": "round(100e0 * (n_rows - n) / n_rows, 2) between 5.001 and 40",
        "is_skewed": "coalesce(abs(skew) > 1, false)",
        "is_zero_inflated": "zero",
        "leakage_suspect": "case when not target then coalesce(abs(corr) > 0.95, false) end",
        "missingness_informative": "coalesce(abs(mcorr) > 0.3, false)",
        "missingness_leakage_suspect": "coalesce(abs(mcorr) > 0.7, false)",
        "is_low_variance": "num and k > 1 and k / (n_rows * 1e0) < 0.5 and coalesce(cv < 0.01, false)",
        "is_numeric_but_categorical": "num and k <= 10 and whole",
        "is_duplicate_of_other_column": "dup is not null",
    }
    numbers = {
        "nunique": "k * 1e0",
        "missing_pct": "round(100e0 * (n_rows - n) / n_rows, 2)",
        "skew": "skew",
        "corr_with_target": "corr",
        "missingness_target_corr": "mcorr",
    }
    rows = [
        f"select 'col:' || c || ':{m}' as metric_key, null::double as num_value, {e} as bool_value from s"
        for m, e in flags.items()
    ] + [f"select 'col:' || c || ':{m}', round({e}, 6), null from s" for m, e in numbers.items()]
    return f"with {LINES}, s as ({stats_sql()}) {' union all '.join(rows)}"


LONG_METRICS = tuple(m for m in ds.FLAG_METRICS if m != "is_multicollinear") + (
    "nunique", "missing_pct", "skew", "corr_with_target", "missingness_target_corr",
)


@query("prof_flags_long", long_sql())
def prof_flags_long(spark, sf):
    """The whole profile of the line frame, less the metrics the other queries cover."""
    flagged = ds.with_flags(ds.column_statistics(lines(spark, sf), TARGET))
    long = ds.column_metrics(flagged).where(F.col("metric").isin(*LONG_METRICS))
    return long.select("metric_key", F.round("num_value", 6).alias("num_value"), "bool_value")


@query(
    "prof_dataset_metrics",
    """with o as (select o_orderstatus, o_orderpriority from orders),
g as (select o_orderstatus, o_orderpriority, count(*) as n from o group by 1, 2),
b as (select o_orderstatus as v, round(count(*) / (sum(count(*)) over () * 1e0), 4) as s, count(*) as n from o group by 1)
select 'n_rows' as metric_key, cast(sum(n) as double) as num_value, null::boolean as bool_value, null as text from g
union all select 'n_cols', 2, null, null
union all select 'n_duplicated_rows', cast(sum(n - 1) as double), null, null from g
union all select 'target_dtype', null, null, 'string'
union all select 'target_class_balance', null, null, string_agg(v || '=' || s, ',' order by v) from b
union all select 'target_skew', null, null, null
union all select 'target:is_imbalanced', null, min(n) / (sum(n) * 1e0) < case when count(*) = 2 then 0.2 else 0.05 end,
  null from b""",
)
def prof_dataset_metrics(spark, sf):
    frame = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    metrics = ds.dataset_metrics(frame, "o_orderstatus", "multiclass")
    entries = F.transform(
        F.map_entries("map_value"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    text = F.coalesce("str_value", F.array_join(entries, ","))
    return metrics.select("metric_key", "num_value", "bool_value", text.alias("text"))


@query(
    "metric_key_parse",
    """with k as (select l_orderkey, case l_linenumber when 1 then 'target:is_imbalanced' when 2 then 'n_rows'
  else 'col:c' || l_suppkey || ':is_skewed' end as metric_key from lineitem)
select metric_key, count(*) as cited, case when metric_key = 'target:is_imbalanced' then metric_key
  when metric_key = 'n_rows' then 'n_rows' else 'is_skewed' end as rule_name from k group by 1, 3""",
)
def metric_key_parse(spark, sf):
    key = (
        F.when(F.col("l_linenumber") == 1, "target:is_imbalanced")
        .when(F.col("l_linenumber") == 2, "n_rows")
        .otherwise(F.concat(F.lit("col:c"), F.col("l_suppkey").cast("string"), F.lit(":is_skewed")))
    )
    cited = table(spark, sf, "lineitem").groupBy(key.alias("metric_key")).agg(F.count("*").alias("cited"))
    return cited.withColumn("rule_name", audit.rule_name(F.col("metric_key")))


@query(
    "allowed_evidence",
    """with kept as (select 'quantity' as c where (select avg(l_quantity) from lineitem) >= 1
  union all select 'discount' where (select avg(l_discount) from lineitem) >= 1
  union all select 'tax' where (select avg(l_tax) from lineitem) >= 1
  union all select 'linenumber' where (select avg(l_linenumber) from lineitem) >= 1),
metric as (select unnest(['nunique', 'missing_pct', 'mean', 'std', 'min', 'max', 'median', 'skew', 'kurtosis',
  'iqr_outlier_pct', 'nonzero_pct', 'top_category_pct', 'corr_with_target', 'max_abs_corr_other', 'vif',
  'missingness_target_corr', 'missingness_cluster_corr_max', 'has_missing', 'is_sequential', 'is_high_cardinality',
  'is_constant', 'is_id_like', 'has_high_missing', 'has_moderate_missing', 'is_multicollinear', 'is_skewed',
  'is_zero_inflated', 'leakage_suspect', 'missingness_informative', 'missingness_leakage_suspect', 'is_low_variance',
  'is_numeric_but_categorical', 'is_duplicate_of_other_column', 'dtype', 'duplicate_of']) as m)
select 'col:' || c || ':' || m as metric_key from kept, metric union all select unnest(['n_rows', 'n_duplicated_rows',
  'target_dtype', 'target_class_balance', 'target_skew', 'target:is_imbalanced'])""",
)
def allowed_evidence(spark, sf):
    """Profile of four columns; a plan keeps those whose mean is at least one."""
    long = ds.profile(lines(spark, sf).select("quantity", "discount", "tax", "linenumber"), TARGET, "regression")
    kept = long.where("metric = 'mean' and num_value >= 1").select("column_name")
    return audit.allowed_evidence(long, kept)


@query(
    "planted_identified",
    f"""with z as (select o_totalprice as y, {sql_normal("o_orderkey", "leak")} as z, {sql_normal("o_orderkey", "high_missing")} as h,
  row_number() over (order by md5(o_orderkey || '|missing'), o_orderkey) as r,
  cast(round_even(count(*) over () * 0.6, 0) as bigint) as gone, 1 as same, 0 as given from orders
  where o_totalprice is not null),
m as (select avg(y) as my, avg(z) as mz, var_pop(y) as vy, var_pop(z) as vz, covar_pop(y, z) as c from z),
p as (select y, same, given, case when r > gone then h end as gap, y + ((z - mz) - (y - my) * c / vy) * sqrt(vy)
  * sqrt(1 / (0.99e0 * 0.99e0) - 1) / sqrt(vz - c * c / vy) as leak from z, m
  union all select null, 1, 0, null, null from orders where o_totalprice is null),
f as (select 'SYNTH_CONSTANT' as c, 'constant' as d, count(distinct same) <= 1 as hit from p
  union all select 'given', 'constant', count(distinct given) <= 1 from p
  union all select 'SYNTH_LEAKED', 'constant', count(distinct leak) <= 1 from p
  union all select 'SYNTH_HIGH_MISSING', 'constant', count(distinct gap) <= 1 from p
  union all select 'SYNTH_LEAKED', 'leakage', abs(corr(leak, y)) > 0.95 from p
  union all select 'SYNTH_HIGH_MISSING', 'leakage', abs(corr(gap, y)) > 0.95 from p
  union all select 'SYNTH_HIGH_MISSING', 'high_missing', round(100e0 * (count(*) - count(gap)) / count(*), 2) > 40 from p
  union all select 'SYNTH_LEAKED', 'high_missing', round(100e0 * (count(*) - count(leak)) / count(*), 2) > 40 from p)
select d as defect, min(c) as column_name, count(*) as matches, count(*) = 1 as unambiguous from f where hit group by 1""",
)
def planted_identified(spark, sf):
    """Defects planted into orders and found again by their profile flags; a second constant column is ambiguous.

    Orders without a total can't be planted; they are profiled with the others.
    """
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(0).alias("given"))
    planted = cor.plant_defects(orders.where("o_totalprice is not null"), "o_totalprice", "o_orderkey")
    rest = orders.where("o_totalprice is null").withColumn(cor.CONSTANT, F.lit(1))
    planted = planted.unionByName(rest, allowMissingColumns=True)
    return ds.planted_defects(ds.profile(planted, "o_totalprice", "regression"), [*cor.COLUMNS, "given"])


@query(
    "prof_two_datasets",
    """with s as (select 'supplier' as entity, s_acctbal as b, s_nationkey as n from supplier),
c as (select 'customer' as entity, c_acctbal as b, c_nationkey as n from customer),
u as (select * from s union all select * from c),
d as (select entity, cast(sum(k - 1) as bigint) as again from (select entity, b, n, count(*) as k from u group by all) group by 1)
select u.entity, 'col:balance:mean' as metric_key, round(avg(b), 6) as value from u group by 1
union all select entity, 'col:nation:nunique', count(distinct n) * 1e0 from u group by 1
union all select entity, 'col:balance:corr_with_target', round(corr(b, n), 6) from u group by 1
union all select entity, 'n_rows', count(*) * 1e0 from u group by 1
union all select entity, 'n_duplicated_rows', again * 1e0 from d""",
)
def prof_two_datasets(spark, sf):
    """Profiles of two datasets kept in one table, a folder each."""
    path = shared_dir(spark, "profiles")
    frames = {}
    for name in ("supplier", "customer"):
        columns = (F.col(f"{name[0]}_acctbal").alias("balance"), F.col(f"{name[0]}_nationkey").alias("nation"))
        frames[name] = (table(spark, sf, name).select(*columns), "nation", "regression")
    ds.save_profiles(frames, path)
    asked = ["col:balance:mean", "col:nation:nunique", "col:balance:corr_with_target", "n_rows", "n_duplicated_rows"]
    kept = spark.read.parquet(path).where(F.col("metric_key").isin(asked))
    return kept.select("entity", "metric_key", F.round("num_value", 6).alias("value"))


@query(
    "profile_audit",
    """with v as (select l_linenumber as k, case l_linenumber when 1 then avg(l_quantity) over () when 2 then
  avg(l_quantity) over () * 1.005 when 3 then avg(l_quantity) over () * 1.02 else 1e0 end as claimed from lineitem)
select case k when 4 then 'col:l_quantity:nothing' else 'col:l_quantity:mean' end as metric_key, case when k in (1, 2) then
  'EVIDENCE_ACCURATE' when k = 4 then 'FABRICATED_EVIDENCE' else 'EVIDENCE_MISSTATED' end as layer1_code, count(*) as citations
from v group by 1, 2""",
)
def profile_audit(spark, sf):
    """Claims about a computed profile: right, nearly right, wrong and invented."""
    lines_ = table(spark, sf, "lineitem").select("l_quantity", "l_tax", "l_linenumber")
    long = ds.profile(lines_.select("l_quantity", "l_tax"), "l_tax", "regression")
    renamed = {f"real_{k}": F.col(f"{k}_value") for k in ("num", "bool", "str", "map")}
    real = long.select("metric_key", *[v.alias(k) for k, v in renamed.items()])
    mean = lines_.agg(F.avg("l_quantity").alias("m"))
    k = F.col("l_linenumber")
    claimed = F.when(k == 1, F.col("m")).when(k == 2, F.col("m") * 1.005).when(k == 3, F.col("m") * 1.02).otherwise(1.0)
    key = F.when(k == 4, "col:l_quantity:nothing").otherwise("col:l_quantity:mean")
    evidence = lines_.join(F.broadcast(mean)).select(key.alias("metric_key"), *audit.value_columns("claimed", num=claimed))
    judged = audit.verdicts(audit.resolve(evidence, real))
    return judged.groupBy("metric_key", "layer1_code").agg(F.count("*").alias("citations"))
