"""Session settings the jobs are designed for."""

from __future__ import annotations

import os
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Large joins run on response and prompt ids. One id may carry a large part of the rows, so a
# skewed partition is split even when that costs the stage above it a shuffle of its own.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A batch of texts, and of all that is found in them, has to fit a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


# The most bytes of shuffled rows that small partitions are put together to. Sorting and counting them takes many times that
# in memory, so with Spark's 64 MB a task grows with the input long after the number of tasks could.
PARTITION_BYTES = 8 << 20
_PARTITION = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_PARTITION)) > PARTITION_BYTES:
        spark.conf.set(_PARTITION, f"{PARTITION_BYTES}b")
    return spark


def local_session(cores: str | int = "*", app: str = "answerlens", **settings: str) -> SparkSession:
    """A single-machine session, for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, where neither PYTHONPATH nor their working folder has it.

    Spark hands the archive to every executor, once per application.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if root not in map(os.path.abspath, filter(None, known)) and context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        archive = os.path.join(tempfile.mkdtemp(prefix="answerlens-"), "answerlens")
        context.addPyFile(shutil.make_archive(archive, "zip", root, "answerlens"))
    return spark


def single_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may go without one; it gets a fresh temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not single_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="answerlens-")


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Write rows to the checkpoint folder and go on from there, so that lost tasks cannot change them."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def written(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Write rows to a fresh table of the shared folder and read them back, with ``counts`` taken on the way.

    Like a checkpoint, but rows are worked out once only.
    """
    folder = f"{shared_folder(rows.sparkSession)}/{name}-{uuid4().hex}"
    seen = Observation()
    counted = rows.observe(seen, *(value.alias(key) for key, value in counts.items())) if counts else rows
    counted.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder), dict(seen.get) if counts else {}
