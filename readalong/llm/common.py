"""Helpers shared by the training-data operators.

Staging: an operator that reads an intermediate result more than once writes it as Parquet below the
folder in ``spark.checkpoint.dir`` (shared by driver and executors) and reads it again, which also cuts
lineage.  Where that setting is absent a local session has a folder of its own; a cluster gets an error.
"""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readalong.sources.shared import shared_folder

#: Text bytes handled at once by a Python worker; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Set the session options that bound a Python worker's memory and the disk that finished shuffles keep."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)),
        ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
    ):
        try:
            spark.conf.set(key, value)
        except Exception as e:  # a setting that this Spark version lacks
            if "CANNOT_MODIFY" not in str(e):
                raise
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/readalong/{name}-{uuid.uuid4().hex[:12]}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def children(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder whose writing was finished, by Spark's own file systems; none if it isn't there."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = fs_path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [f.getPath() for f in fs.listStatus(folder) if f.isDirectory()]
    return [p.toString() for p in found if fs.exists(fs_path(p, "_SUCCESS"))]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that nothing reads any more."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


_STAGED: ContextVar[tuple[list[str], ...]] = ContextVar("staged", default=())


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """The folders staged inside, which are deleted at the end; remove those that will still be read from the list."""
    paths: list[str] = []
    token = _STAGED.set((*_STAGED.get(), paths))
    try:
        yield paths
    finally:
        _STAGED.reset(token)
        for path in paths:
            drop_folder(spark, path)


#: Narrow rows that one task writes.
ROWS_PER_TASK = 50_000


def staged(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it again; the path lets the caller drop it early.

    With ``rows``, about how many narrow rows there are, as many tasks write as these need, instead of one
    for each shuffle partition; the number grows with the rows.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name) + "/t"
    for paths in _STAGED.get():
        paths.append(path)
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / ROWS_PER_TASK)))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column as a string that is never null."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle of this session makes; it follows the cluster's setting, not the data here."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string array without nulls: UTF-8 bytes and len+1 offsets that start at 0."""
    array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64, len(array) + 1 + array.offset)[array.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds at most ``most`` text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.diff(buffers(batch.column(column))[1]))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(start, end - start)
            start = end


#: Text bytes that one numpy pass works on: its 64-bit temporaries then stay within a core's cache.
PASS_BYTES = 1 << 19


def passes(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of small runs of a batch's texts."""
    raw, off = buffers(batch.column(column))
    first = 0
    while first < len(off) - 1:
        end = max(first + 1, int(np.searchsorted(off, off[first] + PASS_BYTES, "right")) - 1)
        yield first, raw[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` under this package's batch limits."""
    tune(df.sparkSession)
    return df.mapInArrow(function, schema)
