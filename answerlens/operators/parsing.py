"""Parsing of whole answers: mentions and citations in one narrow pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.functions.urls import cited_sources
from answerlens.lexicon import NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS
from answerlens.operators.mentions import mention_items, with_hits
from answerlens.schemas import CITATION_ITEMS, MENTION_ITEMS


def given_sources() -> Column:
    return F.coalesce(F.size("citations"), F.lit(0)) > 0


def with_items(
    answers: DataFrame,
    hits: DataFrame | None = None,
    brands: Sequence[str] = (),
    positive: Sequence[str] = POSITIVE_KEYWORDS,
    negative: Sequence[str] = NEGATIVE_KEYWORDS,
) -> DataFrame:
    """Add ``mention_items``, ``citation_items`` and ``from_grounding`` to usable landing rows.

    ``hits`` are the same answers with their brands already found, where a brand list is too long for
    one column per brand.
    """
    found = with_hits(answers, brands) if hits is None else hits
    grounded = F.coalesce("grounded", F.lit(False)) & given_sources()
    return found.select(
        *answers.columns,
        mention_items(F.col("hits"), positive, negative).cast(MENTION_ITEMS).alias("mention_items"),
        cited_sources(F.col("raw_text"), F.col("citations")).cast(CITATION_ITEMS).alias("citation_items"),
        grounded.alias("from_grounding"),
    )


def summarize(parsed: DataFrame, landed: Column, skipped: Column) -> DataFrame:
    """One row of run statistics.

    Grounded citations are those of answers that were grounded and came with sources.
    """
    mentions, citations = F.size("mention_items"), F.size("citation_items")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    counted = parsed.agg(
        F.count("*").alias("processed"),
        total(mentions).alias("total_mentions"),
        total(citations).alias("total_citations"),
        total(F.when(F.col("from_grounding"), citations)).alias("grounded_citations"),
        total(F.when(~F.col("from_grounding"), citations)).alias("fallback_citations"),
    )
    return run_statistics(counted.withColumns({"total_prompts": landed, "skipped": skipped}))


def run_statistics(totals: DataFrame) -> DataFrame:
    """The statistics of runs; answers neither processed nor skipped failed."""
    return totals.select(
        "total_prompts",
        "processed",
        "skipped",
        (F.col("total_prompts") - F.col("processed") - F.col("skipped")).alias("api_errors"),
        "total_mentions",
        "total_citations",
        "grounded_citations",
        "fallback_citations",
    )
