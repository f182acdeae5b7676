"""Shared helpers: staged tables, words and their hashes, Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OUT_BYTES = 8 << 20
BATCH_ROWS = 500
MIX_1 = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; only where that is unset in local mode, one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for folders in _open:
        folders.append(path)
    return path


_open: list[list[str]] = []


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the folders that ``scratch`` gave out inside; what is read from them must be written by then."""
    folders: list[str] = []
    _open.append(folders)
    try:
        yield folders
    finally:
        _open.remove(folders)
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: no lineage, no recomputation."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROW = "__row"
#: Rows of one file that a row key can tell apart.
ROW_BITS = 36


def with_row_key(df: DataFrame) -> DataFrame:
    """``df`` with a number for each row that is the same in every scan: its file and its place there.

    A table that isn't read from files is written first. The list of files is broadcast, as long as the
    one that the driver has of every table.
    """
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index")]
    try:
        placed = df.select("*", *place)
    except AnalysisException:
        df = staged(df, "keyed")
        placed = df.select("*", *place)
    files = sorted(r[0] for r in placed.select("__file").distinct().collect())
    numbered = df.sparkSession.createDataFrame(list(enumerate(files)), "__number bigint, __file string")
    key = F.shiftleft("__number", ROW_BITS) + F.col("__index")
    return placed.join(F.broadcast(numbered), "__file").select(*(F.col(f"`{c}`") for c in df.columns), key.alias(ROW))


def without_rows(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key is not in ``gone``, without the key. Each row moves once, by a key that no two share;
    the join is the same however few go."""
    return keyed.join(gone.hint("shuffle_hash"), ROW, "left_anti").drop(ROW)


def small_batches(spark: SparkSession) -> None:
    """Rows come to Python ``BATCH_ROWS`` at a time at most, so that a worker holds few texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, text) and ``more`` alone, so that no other column can clash; a null text is empty."""
    small_batches(df.sparkSession)
    return df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *(F.col(f"`{c}`") for c in more),
    )


def lowered(text) -> F.Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def binaries(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def word_hashes(words: Iterable[bytes], count: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=count)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


class Rows:
    """Collects rows column by column and gives them out in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.columns: list[list] = [[] for _ in schema]
        self.size = 0

    def add(self, *values, size: int = 32) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.size += size

    def full(self) -> bool:
        return self.size >= OUT_BYTES

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            arrays = [pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
        self.columns = [[] for _ in self.schema]
        self.size = 0


class Chunks:
    """The same for numpy arrays: one array per column and call."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.parts: list[list[np.ndarray]] = [[] for _ in schema]
        self.count = 0

    def add(self, *arrays: np.ndarray) -> None:
        for part, array in zip(self.parts, arrays, strict=True):
            part.append(array)
        self.count += len(arrays[0])

    def full(self) -> bool:
        return self.count >= 200_000

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.count:
            arrays = [pa.array(np.concatenate(p), type=f.type) for p, f in zip(self.parts, self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
        self.parts = [[] for _ in self.schema]
        self.count = 0
