"""Registry of named queries and of the SQL their results are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_hash32(expr: str, salt: str = "") -> str:
    """The SQL twin of ``functions.hashing.hash32``."""
    text = f"cast({expr} as varchar)" + (f" || '|{salt}'" if salt else "")
    return f"cast(cast('0x' || substr(md5({text}), 1, 8) as ubigint) as bigint)"


def sql_normal(expr: str, salt: str) -> str:
    """The SQL twin of ``functions.hashing.normal``."""
    text = f"cast({expr} as varchar) || '|{salt}'"
    word = "(cast(cast('0x' || substr(md5({t}), {p}, 8) as ubigint) as double) + 0.5e0) / 4294967296e0"
    u1, u2 = word.format(t=text, p=1), word.format(t=text, p=9)
    return f"sqrt(-2e0 * ln({u1})) * cos(2e0 * pi() * {u2})"
