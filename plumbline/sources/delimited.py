"""CSV sources and the checks before profiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.profile.univariate import union_all


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType | None = None,
    sep: str = ",",
    header: bool = True,
    null_value: str | None = None,
    trim: bool = False,
) -> DataFrame:
    """CSV with an explicit schema, or an inferred one (an extra pass; for small files)."""
    reader = spark.read.option("header", str(header).lower()).option("sep", sep)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    if trim:
        reader = reader.option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    return reader.csv(path)


def sniff_separator(spark: SparkSession, path: str, candidates: Sequence[str] = (",", ";", "\t", "|")) -> str:
    """The candidate that splits the header line into most columns."""
    header = spark.read.text(path).first()
    line = header["value"] if header else ""
    return max(candidates, key=line.count)


def read_train_and_test(
    spark: SparkSession, train: str, test: str, schema: str, label: str, null_value: str = "?"
) -> DataFrame:
    """Headerless train and test files as one table: trimmed text, a label without its final dot.

    The first line of the test file is a remark; it parses to a row with nothing after its first field.
    """
    def read(path):
        return read_csv(spark, path, schema, header=False, null_value=null_value, trim=True)

    tested = read(test)
    remark = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in tested.columns[1:]]).isNull()
    rows = read(train).unionByName(tested.where(~remark))
    text = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)}
    trimmed = rows.select(
        *[F.trim(F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`") for c in rows.columns]
    )
    return trimmed.withColumn(label, F.regexp_replace(F.col(f"`{label}`"), r"\.$", ""))


def coerce_numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Text to number where it is one, NULL elsewhere; absent columns are left out."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in names if c in df.columns})


def looks_numeric(column: Column) -> Column:
    return F.avg(F.when(column.isNotNull(), column.try_cast("double").isNotNull().cast("double")))


def numeric_looking(df: DataFrame) -> DataFrame:
    """Share of values that parse as numbers, per text column, over all rows."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    row = df.agg(*[looks_numeric(F.col(f"`{c}`")).alias(c) for c in names])
    return row.unpivot([], names, "column_name", "numeric_share").withColumn(
        "numeric_looking", F.coalesce(F.col("numeric_share") > 0.98, F.lit(False))
    )


def preflight(df: DataFrame, target: str, task_type: str) -> DataFrame:
    """Issues that would spoil a profile: one row each."""
    spark = df.sparkSession
    issues = []
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if repeated:
        rows = [(c, "duplicate column names") for c in repeated]
        return spark.createDataFrame(rows, "column_name string, issue string")
    if task_type == "regression" and not isinstance(df.schema[target].dataType, T.NumericType):
        fixed = spark.createDataFrame(
            [(target, "regression target is non-numeric")], "column_name string, issue string"
        )
        issues.append(fixed)
    gaps = df.agg(F.count_if(F.col(f"`{target}`").isNull()).alias("n")).where("n > 0")
    issues.append(
        gaps.select(
            F.lit(target).alias("column_name"),
            F.concat(F.lit("target has "), F.col("n").cast("string"), F.lit(" missing values")).alias("issue"),
        )
    )
    if any(isinstance(f.dataType, T.StringType) for f in df.schema.fields):
        issues.append(
            numeric_looking(df).where("numeric_looking").select("column_name", F.lit("numeric-looking text").alias("issue"))
        )
    return union_all(issues)
