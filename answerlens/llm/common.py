"""Helpers shared by the operators: input columns, the shared folder, written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.session import single_machine


def tuned(spark: SparkSession) -> SparkSession:
    """Bound the rows an Arrow batch holds, so that a batch of long texts still fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, unset on one machine, a part of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not single_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back: cuts lineage, and lost executors cannot change them."""
    folder = new_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove the files of ``settled`` tables that nothing will read again, and let Spark remove the shuffle files of finished jobs.

    Spark does the latter when the driver's garbage collector finds their plans unused, which on a quiet driver may be after
    hours; until then they fill the executors' disks.
    """
    jvm = spark.sparkContext._jvm
    folders = {path.rsplit("/", 1)[0] for table in tables for path in table.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on; a null text counts as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def set_aside(rows: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with all columns but ``keep`` renamed, so that no name of theirs can clash, and what gives the names back."""
    plain = [c if c in keep else f"_column_{i}" for i, c in enumerate(rows.columns)]

    def back(found: DataFrame) -> DataFrame:
        return found.select(*(F.col(f"`{p}`").alias(c) for p, c in zip(plain, rows.columns, strict=True)))

    return rows.toDF(*plain), back


def joined_by(rows: DataFrame, one_each: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Inner join of many ``rows`` with a written table of one row per ``key``, whose column ``n`` says how many they are.

    Keys that over a thousandth of the counted rows have, which can only be a thousand, go by broadcast, so that no key
    is a large part of a task of the shuffled join, whatever its size in bytes.
    """
    total = one_each.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()[0]
    hot = F.col(n) * 1000 > total
    frequent = F.broadcast(one_each.where(hot))
    rare = rows.join(F.broadcast(one_each.where(hot).select(key)), key, "left_anti")
    return rows.join(frequent, key).unionByName(rare.join(one_each.where(~hot), key)).drop(n)


def task_sums(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum over all rows of the array ``partial(batch)``, flat; None without rows.

    Every task gives one array, whose entries Spark adds up, so what reaches the driver has the size of one array.
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = np.asarray(partial(batch), float).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

    sums = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    return sums.sort_values("at")["value"].to_numpy() if len(sums) else None
