"""Joins, filters and key rules over the three fact tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.schemas import UNKNOWN_STAGE


@dataclass(frozen=True)
class Facts:
    """Responses with their stage, and the mentions and citations that belong to them."""

    responses: DataFrame
    mentions: DataFrame
    citations: DataFrame


def responses_with_stage(responses: DataFrame, prompts: DataFrame) -> DataFrame:
    """Left join adding ``text`` and ``stage``; a deleted prompt leaves both NULL.

    Only if there are no prompts at all is every stage ``unknown``. Spark broadcasts the prompts while
    they are below its size threshold and splits hot prompts of a sort-merge join beyond it.
    """
    dimension = prompts.select(F.col("id").alias("_prompt"), "text", "stage")
    joined = responses.join(dimension, responses.prompt_id == F.col("_prompt"), "left")
    no_prompts = ~prompts.exists()
    return joined.select(
        *[responses[c] for c in responses.columns],
        F.coalesce("text", F.when(no_prompts, "")).alias("text"),
        F.coalesce("stage", F.when(no_prompts, UNKNOWN_STAGE)).alias("stage"),
    )


def is_filter(value: str | None) -> bool:
    """None, the empty string and ``All`` all mean "do not filter"."""
    return bool(value) and value != "All"


def select_responses(
    responses: DataFrame, prompts: DataFrame, stage: str | None = None, platform: str | None = None
) -> DataFrame:
    """Responses with stage, filtered; the columns metrics need, so never the answer text."""
    narrow = responses.select("id", "prompt_id", "platform")
    if is_filter(platform):
        narrow = narrow.filter(F.col("platform") == platform)
    if is_filter(stage) and stage != UNKNOWN_STAGE:
        # Filtering the dimension first leaves an inner join against a fraction of it.
        wanted = prompts.filter(F.col("stage") == stage).select(F.col("id").alias("prompt_id"), "stage")
        return narrow.join(wanted, "prompt_id").select("id", "prompt_id", "platform", "stage")
    staged = responses_with_stage(narrow, prompts).drop("text")
    return staged.filter(F.col("stage") == stage) if is_filter(stage) else staged


def of_responses(facts: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows of a fact table that belong to the given responses, with their stage and platform.

    One inner join serves as the semi join and as the lookup.
    """
    keys = responses.select(F.col("id").alias("response_id"), "stage", "platform")
    return facts.join(keys, "response_id").select(*[facts[c] for c in facts.columns], "stage", "platform")


def filtered_facts(
    responses: DataFrame,
    mentions: DataFrame,
    citations: DataFrame,
    prompts: DataFrame,
    stage: str | None = None,
    platform: str | None = None,
) -> Facts:
    selected = select_responses(responses, prompts, stage, platform)
    return Facts(selected, of_responses(mentions, selected), of_responses(citations, selected))


def latest_responses(responses: DataFrame) -> DataFrame:
    """The response with the highest id of each prompt and platform.

    Finding the ids is a plain maximum that combines before the shuffle, so a hot prompt costs nothing;
    the rows are then fetched by id. A window would sort all texts of a hot prompt in one task.
    """
    newest = responses.groupBy("prompt_id", "platform").agg(F.max("id").alias("id"))
    return responses.join(newest.select("id"), "id", "left_semi").select(*responses.columns)


def delete_responses(
    responses: DataFrame, mentions: DataFrame, citations: DataFrame, keys: DataFrame
) -> Facts:
    """Fact tables without the responses of the given ``prompt_id, platform`` pairs."""
    doomed = responses.select("id", "prompt_id", "platform").join(keys, ["prompt_id", "platform"], "left_semi")
    gone = doomed.select(F.col("id").alias("response_id"))
    return Facts(
        responses.join(doomed.select("id"), "id", "left_anti").select(*responses.columns),
        mentions.join(gone, "response_id", "left_anti").select(*mentions.columns),
        citations.join(gone, "response_id", "left_anti").select(*citations.columns),
    )


def orphans(facts: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows whose response does not exist."""
    keys = responses.select(F.col("id").alias("response_id"))
    return facts.join(keys, "response_id", "left_anti").select(*facts.columns)


def enforce_references(facts: DataFrame, responses: DataFrame) -> DataFrame:
    keys = responses.select(F.col("id").alias("response_id"))
    return facts.join(keys, "response_id", "left_semi").select(*facts.columns)
