"""Session helpers: the folder that all executors share, and the package on their path."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Tasks, for each core, that look up files given one by one.
LOOKUPS = 4
_LOOKUPS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batches to ``rows`` (they are never raised)."""
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, str(rows))


def few_lookups(spark: SparkSession) -> None:
    """Lower the session's tasks that look up files to ``LOOKUPS`` a core (they are never raised): Spark's own
    bound makes one for each of 10,000 files."""
    most = LOOKUPS * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(_LOOKUPS)) > most:
        spark.conf.set(_LOOKUPS, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where the cluster names none (local tests) a temporary folder is set for the session.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="lodeworks-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again: lineage is cut, lost executors cost only
    their tasks, and what follows may read it more than once."""
    path = f"{shared_dir(df.sparkSession)}/lodeworks/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers that would not find it themselves (once a session)."""
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if _ROOT in known or os.getcwd() == _ROOT or getattr(sc, "_lodeworks_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lodeworks-zip-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "lodeworks"), "zip", _ROOT, "lodeworks"))
    sc._lodeworks_shipped = True
