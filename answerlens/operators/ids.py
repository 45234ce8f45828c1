"""Surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.session import written


def next_id(rows: DataFrame, id_col: str = "id") -> Column:
    """``max + 1``, or 1 for an empty table, as a scalar subquery."""
    return rows.agg(F.coalesce(F.max(id_col), F.lit(0)) + 1).scalar()


def with_sequential_ids(rows: DataFrame, order_col: str, start: Column, id_col: str = "id") -> DataFrame:
    """Gapless ids in the order of a unique integer column, without sorting everything in one task.

    Only that column is sorted, by ranges, as many as the session has shuffle partitions: a row's number is its place in its
    range and the number of rows in the ranges before. The numbered column is written, so that the ranges cannot change,
    and joined back by hash; the rows themselves are neither sorted nor written.
    """
    ranged = rows.select(F.col(order_col).alias("_numbered_by")).repartitionByRange("_numbered_by").sortWithinPartitions("_numbered_by")
    placed, _ = written(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "keys")
    # One row per range.
    ranges = placed.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    before = F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = ranges.select("_range", F.coalesce(before, F.lit(0)).alias("_before"), "_first")
    numbers = placed.join(F.broadcast(offsets), "_range").select("_numbered_by", (F.col("_before") + F.col("_at") - F.col("_first")).alias("_number"))
    numbered = rows.join(numbers.hint("shuffle_hash"), F.col(order_col) == F.col("_numbered_by"))
    return numbered.withColumn(id_col, (start + F.col("_number")).cast("long")).drop("_numbered_by", "_number")


def with_unique_ids(rows: DataFrame, start: int, id_col: str = "id") -> DataFrame:
    """Unique increasing ids with gaps, without any shuffle.

    They depend on how the plan is split into partitions, so write the result once and read the table
    from then on.
    """
    return rows.withColumn(id_col, F.monotonically_increasing_id() + F.lit(start))
