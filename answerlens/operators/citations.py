"""Cited sources of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.functions.urls import cited_sources, text_sources


def _exploded(answers: DataFrame, id_col: str, items: Column) -> DataFrame:
    # The outer form, for the reason given in ``operators.mentions``.
    rows = answers.select(F.col(id_col).alias("response_id"), F.posexplode_outer(items).alias("at", "item"))
    return rows.filter(F.col("item").isNotNull()).select("response_id", (F.col("at") + 1).alias("seq"), "item.source_url", "item.source_domain")


def extract_citations(
    answers: DataFrame, id_col: str = "id", text_col: str = "raw_text", sources_col: str | None = None
) -> DataFrame:
    """``response_id, seq, source_url, source_domain``, from the grounded sources where there are any.

    Without ``sources_col`` the text alone is searched.
    """
    text = F.col(text_col)
    items = text_sources(text) if sources_col is None else cited_sources(text, F.col(sources_col))
    return _exploded(answers, id_col, items)
