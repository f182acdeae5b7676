"""Typed Parquet export of normalized runs with a hashed manifest."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.normalize import normalize_runs, read_artifacts
from plumbline.sources.runs import RunFolder, artifact_digests, locate, open_runs
from plumbline.sources.schemas import TABLES
from plumbline.sources.secrets import refuse_secrets

#: Largest file whose plain digest is taken, in one piece.
WHOLE_BYTES = 64 << 20
#: Tables written at a time: small ones fill the cores that the last tasks of a large one leave idle.
WRITERS = 4
MANIFEST_SCHEMA = "table_name string, path string, row_count bigint"


def write_counted(frame: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Writes a table and returns its row count as observed by the write itself."""
    seen = Observation()
    frame.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").format(fmt).save(path)
    return int(seen.get["rows"])


def source_manifest(spark: SparkSession, root: str | RunFolder) -> DataFrame:
    """Path, size, lines and hash-tree digest of every artifact, whatever its size.

    ``sha256`` is the digest of the bytes as they are, for single files of at most ``WHOLE_BYTES``: it can't
    be put together from parts, so larger ones have it null and are told by ``tree_sha256``.
    """
    folder = open_runs(spark, root)
    small = (
        folder.entries.where(F.col("length") <= WHOLE_BYTES)
        .select(*locate(F.col("path"), folder.root), F.sha2("content", 256).alias("sha256"))
        .where("run_id is not null")
    )
    return (
        artifact_digests(spark, folder)
        .join(small, ["run_id", "artifact"], "left")
        .select(F.concat("run_id", F.lit("/"), "artifact").alias("path"), "size_bytes", "n_lines", "tree_sha256", "sha256")
    )


def export_runs(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Normalizes every run below ``root`` into ``out``; refuses before writing if a secret is found.

    Layout: ``{table}/`` per table, ``source_files/`` with hashes, ``manifest/`` with row counts.
    """
    folder = open_runs(spark, root)
    refuse_secrets(spark, folder)
    def written(named: tuple[str, DataFrame]) -> tuple[str, int, DataFrame]:
        name, table = named
        rows = write_counted(table, f"{out}/{name}")
        return name, rows, spark.read.schema(table.schema).parquet(f"{out}/{name}")

    rows = {}
    with ThreadPoolExecutor(max_workers=WRITERS) as pool:
        files = pool.submit(source_manifest(spark, folder).write.mode("overwrite").parquet, f"{out}/source_files")

        def stored(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
            found = list(pool.map(written, tables.items()))
            rows.update({name: n for name, n, _ in found})
            return {name: table for name, _, table in found}

        normalize_runs(read_artifacts(spark, folder), stored)
        files.result()
    counts = [(name, name, rows[name]) for name in TABLES]
    manifest = spark.createDataFrame(counts, MANIFEST_SCHEMA).withColumns(
        {
            "schema_version": F.lit(1),
            "created_at_utc": F.lit(datetime.now(timezone.utc).isoformat()),
            "runs_dir": F.lit(root),
        }
    )
    manifest.coalesce(1).write.mode("overwrite").json(f"{out}/manifest")
    return spark.read.json(f"{out}/manifest")
