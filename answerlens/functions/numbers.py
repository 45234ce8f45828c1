"""Percentages and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole) * 100


def round_scaled(value: Column, digits: int) -> Column:
    """Half-even after scaling, the rule of columnar float rounding."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def round_exact(value: Column, digits: int) -> Column:
    """Half-even on the exact binary value, the rule of scalar float rounding."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).cast("double")
