"""Run directories as tables of lines and documents.

The frames here carry (run_id, artifact, line_no, value) for line files and (run_id, artifact,
value) for JSON documents; ``plans.normalize`` turns them into the twelve tables. An artifact is a
file, or a folder of part files as Spark writes them, whose lines follow each other in path order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.schemas import RUN_NAME

LINES_PER_BUCKET = 100_000


def run_identity(name: Column) -> list[Column]:
    """Identity columns encoded in a run name; all NULL when the name does not match."""
    matches = name.rlike(RUN_NAME)

    def part(i):
        return F.when(matches, F.regexp_extract(name, RUN_NAME, i))

    code = F.concat(F.lit("t"), part(3))
    return [
        part(1).alias("dataset"),
        part(2).alias("arm"),
        code.alias("temperature_code"),
        F.when(code == "t00", 0.0).when(code == "t07", 0.7).alias("temperature"),
        part(4).try_cast("bigint").alias("repeat"),
    ]


def below(path: Column, root: str) -> Column:
    """The part of a file's path below ``root`` (an absolute path, with or without a scheme)."""
    folder = re.sub(r"^[A-Za-z0-9+.-]+:/*", "", root).strip("/")
    return F.regexp_extract(path, f"^.*?/{re.escape(folder)}/(.*)$", 1)


def locate(path: Column, root: str) -> list[Column]:
    """Run directory and relative file name below ``root``; NULL for anything else."""
    tail = below(path, root)
    name = F.substring_index(tail, "/", 1)
    run = F.when(name.rlike(RUN_NAME) & tail.contains("/"), name)
    return [run.alias("run_id"), F.when(run.isNotNull(), F.substring(tail, F.length(name) + 2, F.length(tail))).alias("artifact")]


@dataclass(frozen=True)
class RunFolder:
    """A folder of run directories, listed when it is opened; every reader takes its files from here.

    ``entries`` has path and size of every file, and contents where they are asked for; ``text`` has
    the lines. A filter on the file name drops files from the listing, before any is opened.
    """

    spark: SparkSession
    root: str
    entries: DataFrame
    text: DataFrame


def open_runs(spark: SparkSession, root: str | RunFolder) -> RunFolder:
    """Lists ``root`` once for names and sizes and once for lines; an open folder comes back as it is."""
    if isinstance(root, RunFolder):
        return root
    # Only "\n" ends a line, so that lines give back the bytes of a file.
    reader = spark.read.option("recursiveFileLookup", "true")
    return RunFolder(spark, root, reader.format("binaryFile").load(root), reader.option("lineSep", "\n").format("text").load(root))


def artifact_name(tail: Column) -> Column:
    """The artifact a file belongs to: itself, or the folder of part files it lies in."""
    return F.regexp_replace(tail, "/part-[^/]*$", "")


def run_files(spark: SparkSession, root: str | RunFolder) -> DataFrame:
    """The inventory: every file of every run directory with its size and kind, without reading contents.

    Spark's file sources leave out files of no bytes, so these count as missing.
    ``kind`` is what follows the last dot of the artifact (empty without one); ``artifact`` joins part files.
    """
    folder = open_runs(spark, root)
    base = F.element_at(F.split("artifact", "/"), -1)
    return (
        folder.entries.select("path", F.col("length").alias("size_bytes"), *locate(F.col("path"), folder.root))
        .where("run_id is not null")
        .withColumnRenamed("artifact", "file")
        .withColumn("artifact", artifact_name(F.col("file")))
        .withColumn("kind", F.regexp_extract(base, r"\.([^.]*)$", 1))
        .withColumn("source_run_dir", F.concat(F.lit(folder.root.rstrip("/") + "/"), "run_id"))
    )


def rejected_directories(spark: SparkSession, root: str | RunFolder) -> DataFrame:
    """Names below ``root`` that are not run directories."""
    folder = open_runs(spark, root)
    name = F.substring_index(below(F.col("path"), folder.root), "/", 1)
    return folder.entries.select(name.alias("name")).where(~name.rlike(RUN_NAME)).distinct()


def _named(frame: DataFrame, artifact: str | None) -> DataFrame:
    """Rows of the files that can be this artifact by their name; the file name alone prunes the listing."""
    if artifact is None:
        return frame
    name, path = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    last = artifact.rsplit("/", 1)[-1]
    return frame.where((name == last) | (name.startswith("part-") & path.contains(f"/{last}/part-")))


def placed(frame: DataFrame, root: str, artifact: str | None = None) -> DataFrame:
    """Run and artifact of rows that carry ``_path``: those of runs, or of one artifact of them.

    Rows are unpacked from a list, not filtered: Spark would move the filter, with its patterns over paths, to every line
    that is read.
    """
    found = frame.select("*", *locate(F.col("_path"), root))
    found = found.withColumn("artifact", artifact_name(F.col("artifact")))
    wanted = F.col("run_id").isNotNull() if artifact is None else F.col("artifact") == artifact
    return found.select(F.inline(F.when(wanted, F.array(F.struct(*found.columns)))))


def artifact_lines(
    spark: SparkSession, root: str | RunFolder, artifact: str | None = None, as_bytes: bool = False
) -> DataFrame:
    """Lines of one artifact (or of all) over all runs, numbered from one.

    Files stay splittable: lines are numbered inside each split, and splits are offset by the lines
    before them, so no file is read by a single task. A carriage return ends a line, too, unless the
    lines are wanted ``as_bytes``.
    """
    folder = open_runs(spark, root)
    text = _named(folder.text, artifact).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block")
    )
    if not as_bytes:
        text = at_returns(text)
    return number_lines(text.withColumn("_id", F.monotonically_increasing_id()), folder.root, artifact).select(
        "run_id", "artifact", "line_no", "value"
    )


def at_returns(text: DataFrame) -> DataFrame:
    """Lines cut at carriage returns; one at the end of a line belongs to its end."""
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\r")
    return text.withColumn("value", F.explode(F.when(F.contains("value", F.lit("\r")), parts).otherwise(F.array("value"))))


def number_lines(text: DataFrame, root: str, artifact: str | None = None) -> DataFrame:
    """Adds run, artifact and ``line_no`` from (_path, _block, _id); the lines of a split follow each other in ``_id``, which
    counts rows.

    So only a row a split is placed below ``root``, shuffled, ordered and sent to the tasks; lines stay where they were read,
    and lines of no run, or of another artifact, find no such row.
    """
    sizes = text.groupBy("_path", "_block").agg(F.count("*").alias("_size"), F.min("_id").alias("_first"))
    splits = Window.partitionBy("run_id", "artifact").orderBy(F.length("_path"), "_path", "_block")
    before = F.sum("_size").over(splits) - F.col("_size") - F.col("_first")
    offsets = placed(sizes, root, artifact).withColumn("_offset", before).drop("_size", "_first")
    return (
        text.join(F.broadcast(offsets), ["_path", "_block"])
        .withColumn("line_no", F.col("_id") + 1 + F.col("_offset"))
        .drop("_offset", "_path", "_block", "_id")
    )


def artifact_documents(spark: SparkSession, root: str | RunFolder, artifact: str) -> DataFrame:
    """One JSON document per run; of a folder of part files, one per file."""
    folder = open_runs(spark, root)
    value = F.col("content").cast("string").alias("value")
    found = _named(folder.entries, artifact).select(value, F.col("_metadata.file_path").alias("_path"))
    return placed(found, folder.root, artifact).select("run_id", "artifact", "value")


#: Children of a node of the digest tree.
FAN_OUT = 1024


def artifact_digests(spark: SparkSession, root: str | RunFolder) -> DataFrame:
    """(run_id, artifact, size_bytes, n_lines, tree_sha256) of every artifact, of any size.

    A hash tree: the SHA-256 of every line, of each ``FAN_OUT`` of them (hexadecimal, in line order),
    of each ``FAN_OUT`` of those, and of size and all of these. It depends on neither splits nor part
    files; no task holds more than one line and ``FAN_OUT`` digests, the last one a digest for
    each million of lines. Size tells whether the last line has its end, so equal digests mean equal bytes.
    """
    folder = open_runs(spark, root)
    key = ["run_id", "artifact"]
    level = artifact_lines(spark, folder, as_bytes=True).select(
        *key, (F.col("line_no") - 1).cast("bigint").alias("_at"), F.sha2(F.col("value").cast("binary"), 256).alias("_digest")
    )

    def joined(digests):
        return F.array_join(F.transform(F.array_sort(digests), lambda x: x["_digest"]), "")

    counted = level.withColumn("_lines", F.lit(1).cast("bigint"))
    for _ in range(2):
        node = F.floor(F.col("_at") / FAN_OUT).cast("bigint")
        counted = (
            counted.groupBy(*key, node.alias("_node"))
            .agg(F.collect_list(F.struct("_at", "_digest")).alias("_children"), F.sum("_lines").alias("_lines"))
            .select(*key, F.col("_node").alias("_at"), F.sha2(joined(F.col("_children")), 256).alias("_digest"), "_lines")
        )
    roots = counted.groupBy(*key).agg(
        joined(F.collect_list(F.struct("_at", "_digest"))).alias("_nodes"), F.sum("_lines").alias("n_lines")
    )
    sizes = run_files(spark, folder).groupBy(*key).agg(F.sum("size_bytes").alias("size_bytes"))
    text = F.concat(F.col("size_bytes").cast("string"), F.lit(":"), "_nodes")
    return sizes.join(roots, key).select(*key, "size_bytes", "n_lines", F.sha2(text, 256).alias("tree_sha256"))


def position(df: DataFrame, group: str, order: str, output: str) -> DataFrame:
    """Zero-based position by a line number within each group, in buckets of bounded size."""
    tagged = df.withColumn("_bucket", F.floor(F.col(order) / LINES_PER_BUCKET))
    sizes = tagged.groupBy(group, "_bucket").agg(F.count("*").alias("_size"))
    by_bucket = Window.partitionBy(group).orderBy("_bucket")
    offsets = sizes.withColumn("_offset", F.sum("_size").over(by_bucket) - F.col("_size")).drop("_size")
    inside = Window.partitionBy(group, "_bucket").orderBy(order)
    return (
        tagged.withColumn("_position", F.row_number().over(inside))
        .join(offsets, [group, "_bucket"])
        .withColumn(output, F.col("_position") - 1 + F.col("_offset"))
        .drop("_bucket", "_position", "_offset")
    )
