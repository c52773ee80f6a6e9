"""Helpers that the operators of this subpackage share: reading tables, cutting lineage."""

from __future__ import annotations

import ctypes
import functools
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, small_batches

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lean(run):
    """A worker's batch function that gives freed memory back when its task ends: workers are kept,
    and what their allocators hold would add up over the stages of a pipeline."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def _swept(spark: SparkSession):
    """Shuffle files of the plans run here are deleted with them: they serve nothing later."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was) if was is not None else spark.conf.unset(_CLEANUP)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Like ``written``, as a table bucketed by ``keys``: joins on them do not shuffle it again.

    The catalog forgets the table at once (its files stay): the frame that is returned knows its
    files and buckets itself, so no session or metastore fills up with such tables.
    """
    spark = df.sparkSession
    small_batches(spark)
    known = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/lodeworks/{known}"
    with _swept(spark):
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).option("compression", "zstd").saveAsTable(known)
    out = spark.table(known)
    out.schema  # analysed: what follows needs no catalog
    spark.sql(f"DROP TABLE {known}")
    return out


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet below the shared folder and read it again.

    The name is unique, so a rerun never meets a half-written table; Spark's committer makes the
    files visible only when every task has succeeded, so a lost executor costs only its tasks.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/lodeworks/{name}-{uuid.uuid4().hex}"
    with _swept(spark):
        (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = f"{shared_dir(spark)}/lodeworks/"
    for f in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/lodeworks/" in folder.toString() and root.split("://")[-1].lstrip("/") in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def row_keyed(df: DataFrame, name: str) -> tuple[DataFrame, list]:
    """(frame, columns): columns that tell every row of the frame apart, also equal ones.

    Rows of files are told by file and row number; a frame that no files are behind is written once.
    """
    try:
        place = df.select("_metadata.file_path", "_metadata.row_index").schema
    except AnalysisException:
        place = None
    if place is None:
        return written(df.withColumn("_row", F.monotonically_increasing_id()), name), [F.lit(0).cast("long"), F.col("_row")]
    return df, [F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def grouped(batches, keys: int):
    """Groups of rows that are alike in their first ``keys`` columns; the rows must come sorted.

    Yields (key, rows) with the rows as one record batch: a group must be of bounded size.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(i).to_numpy() for i in range(keys)]).astype(np.int64)
        starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(starts, starts[1:]):
            now = tuple(key[a].tolist())
            if held and now != last:
                yield last, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
