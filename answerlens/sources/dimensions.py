"""Prompt and brand files: JSON arrays, small enough to be written by hand."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlens.functions.text import blank, strip
from answerlens.schemas import BRANDS, PROMPTS, empty


def _document(spark: SparkSession, path: str) -> DataFrame | None:
    """The file as one row, or None if there is no such file."""
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _array_text(path: str) -> Column:
    """The document, an empty array for a blank one; anything but an array fails the job."""
    value = strip(F.col("value"))
    wrong = F.raise_error(F.lit(f"{path} does not contain a JSON array")).cast("string")
    return F.when(blank(value), "[]").when(~F.startswith(value, F.lit("[")), wrong).otherwise(value)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """``id, text, stage``. No rows for a missing or blank file; an error for a malformed one."""
    document = _document(spark, path)
    if document is None:
        return empty(spark, PROMPTS)
    items = F.from_json(_array_text(path), T.ArrayType(PROMPTS), {"mode": "FAILFAST"})
    return document.select(F.inline(items))


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """``ord, brand_name`` in file order, strings only, under the same rules as prompts."""
    document = _document(spark, path)
    if document is None:
        return empty(spark, BRANDS)
    items = F.parse_json(_array_text(path)).cast("array<variant>")
    rows = document.select(F.posexplode(items).alias("ord", "item"))
    names = rows.filter(F.schema_of_variant("item") == "STRING")
    return names.select("ord", F.col("item").cast("string").alias("brand_name"))


def brand_names(brands: DataFrame, at_most: int) -> list[str] | None:
    """The names in order, or None if there are more than ``at_most``; never fetches more than that."""
    rows = brands.orderBy("ord").limit(at_most + 1).collect()
    return [row.brand_name for row in rows] if len(rows) <= at_most else None
