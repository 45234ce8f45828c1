"""Visibility metrics over filtered facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.functions.numbers import percentage, round_exact, round_scaled
from answerlens.operators.facts import Facts, is_filter
from answerlens.schemas import SENTIMENTS

# Sorts brands that are not on the seed list behind those that are.
UNLISTED = 2**31 - 1


def total_prompts(facts: Facts) -> DataFrame:
    return facts.responses.agg(F.count_distinct("prompt_id").alias("total_prompts"))


def brand_responses(facts: Facts) -> DataFrame:
    """Distinct responses per brand; duplicates are merged before the shuffle."""
    return facts.mentions.groupBy("brand_name").agg(F.count_distinct("response_id").alias("mention_count"))


def brand_universe(mentioned: DataFrame, brands: DataFrame) -> DataFrame:
    """Seed brands and mentioned brands, each once, by exact name: ``brand_name, ord, mention_count``.

    A union of two small results, in place of a full outer join.
    """
    counted = mentioned.select("brand_name", F.lit(UNLISTED).alias("ord"), "mention_count")
    seeded = brands.select("brand_name", F.col("ord").cast("int"), F.lit(0).cast("long").alias("mention_count"))
    return counted.unionByName(seeded).groupBy("brand_name").agg(
        F.min("ord").alias("ord"), F.sum("mention_count").alias("mention_count")
    )


def _shares(facts: Facts, brands: DataFrame) -> DataFrame:
    universe = brand_universe(brand_responses(facts), brands)
    counted = universe.withColumn("total_prompts", total_prompts(facts).scalar())
    share = percentage(F.col("mention_count"), F.col("total_prompts"))
    return counted.withColumn("mention_share_pct", round_scaled(share, 1))


def any_row(rows: DataFrame) -> Column:
    """Whether there is any row, as a scalar subquery that stops at the first one.

    It reads all columns of ``rows``: the same ones as the aggregate it guards, so that both use the
    same shuffles and the guard adds none.
    """
    return rows.limit(1).agg(F.max(F.struct("*")).isNotNull()).scalar()


def mention_share(facts: Facts, brands: DataFrame) -> DataFrame:
    """Share of prompts whose responses name a brand; zero rows for seed brands nobody names.

    Without any mention at all the result is empty.
    """
    any_mention = any_row(facts.mentions.select("response_id", "brand_name"))
    return (
        _shares(facts, brands)
        .filter(any_mention)
        .orderBy(F.desc("mention_share_pct"), "ord", "brand_name")
        .select("brand_name", "mention_count", "total_prompts", "mention_share_pct")
    )


def _positions(facts: Facts) -> DataFrame:
    return facts.mentions.groupBy("brand_name").agg(
        round_scaled(F.avg("position"), 2).alias("avg_position"), F.count("position").alias("mention_count")
    )


def average_position(facts: Facts) -> DataFrame:
    return _positions(facts).orderBy("avg_position", "brand_name")


def sentiment_breakdown(facts: Facts) -> DataFrame:
    """Mentions per brand and sentiment; a brand with other sentiments only keeps its row of zeros."""
    counts = [F.count_if(F.col("sentiment") == label).alias(label) for label in SENTIMENTS]
    return facts.mentions.groupBy("brand_name").agg(*counts).orderBy("brand_name")


def _domains(facts: Facts) -> DataFrame:
    return facts.citations.groupBy("source_domain").agg(F.count("*").alias("citation_count"))


def citation_domains(facts: Facts) -> DataFrame:
    return _domains(facts).orderBy(F.desc("citation_count"), "source_domain")


def _stage_shares(facts: Facts, brands: DataFrame) -> DataFrame:
    """``stage, ord, brand_name, mention_share_pct`` for every stage seen and every seed brand."""
    # The stages are few: they go to the brands, which may be many.
    totals = facts.responses.groupBy("stage").agg(F.count_distinct("prompt_id").alias("prompts"))
    stages = totals.agg(F.collect_list(F.struct("stage", "prompts"))).scalar()
    grid = brands.select("ord", "brand_name", F.explode(stages).alias("total")).select(
        "total.stage", "total.prompts", "ord", "brand_name"
    )
    counts = facts.mentions.groupBy("stage", "brand_name").agg(F.count_distinct("response_id").alias("n"))
    same = grid.stage.eqNullSafe(counts.stage) & (grid.brand_name == counts.brand_name)
    named = F.when(grid.stage.isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0)
    return grid.join(counts, same, "left").select(
        grid.stage, "ord", grid.brand_name, round_exact(percentage(named, F.col("prompts")), 1).alias("mention_share_pct")
    )


def stage_breakdown(facts: Facts, brands: DataFrame) -> DataFrame:
    """Share of each seed brand within each stage; responses without a stage give rows of zeros.

    Empty without any mention, like the mention share.
    """
    any_mention = any_row(facts.mentions.select("response_id", "brand_name", "stage"))
    return (
        _stage_shares(facts, brands)
        .filter(any_mention)
        .orderBy(F.asc_nulls_last("stage"), "ord")
        .select("stage", "brand_name", "mention_share_pct")
    )


def _share_rank() -> Column:
    return F.struct(
        (-F.col("mention_share_pct")).alias("falling"), "ord", "brand_name", F.col("mention_share_pct").alias("share")
    )


def share_leader(facts: Facts, brands: DataFrame) -> DataFrame:
    """One row: all mentions (counted once per brand and response) and the brand with the top share."""
    return _shares(facts, brands).agg(
        F.coalesce(F.sum("mention_count"), F.lit(0)).alias("total_mentions"), F.min(_share_rank()).alias("leader")
    )


def domain_leader(facts: Facts) -> DataFrame:
    rank = F.struct((-F.col("citation_count")).alias("falling"), "source_domain", "citation_count")
    return _domains(facts).agg(F.min(rank).alias("leader"), F.count("*").alias("domains"))


def _per_stage(facts: Facts) -> DataFrame:
    """Per brand and stage what shares and positions are made of; a response has one stage, so all of it adds up."""
    return facts.mentions.groupBy("brand_name", "stage").agg(
        F.count_distinct("response_id").alias("n"), F.sum("position").alias("positions"), F.count("position").alias("placed")
    )


def leaders(facts: Facts, brands: DataFrame, stage: str | None, intent_stage: str) -> DataFrame:
    """One row: all mentions, and the leaders by share and by position within ``stage``, and by share within ``intent_stage``.

    ``facts`` are those of all stages. One aggregate by brand and stage serves all leaders, and one by stage all numbers of
    prompts. Leaders are structs, NULL where there is none; that of the intent stage is a seed brand.
    """
    chosen = F.col("stage") == stage if is_filter(stage) else F.lit(True)
    intent = F.col("stage") == intent_stage

    def total(value: Column | str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(value))), F.lit(0)).cast("long")

    columns = {"n": ("n", chosen), "positions": ("positions", chosen), "placed": ("placed", chosen), "intent": ("n", intent)}
    named = _per_stage(facts).groupBy("brand_name").agg(*(total(*part).alias(name) for name, part in columns.items()))
    seeds = brands.select("brand_name", F.col("ord").cast("int"), *(F.lit(0).cast("long").alias(name) for name in columns))
    universe = named.select("brand_name", F.lit(UNLISTED).alias("ord"), *columns).unionByName(seeds)
    universe = universe.groupBy("brand_name").agg(F.min("ord").alias("ord"), *(F.sum(name).alias(name) for name in columns))
    prompts = facts.responses.groupBy("stage").agg(F.count_distinct("prompt_id").alias("p"))
    sizes = prompts.agg(F.struct(total("p", chosen).alias("chosen"), total("p", intent).alias("intent"))).scalar()
    rows = universe.withColumn("sizes", sizes).withColumns(
        {
            "share": round_scaled(percentage(F.col("n"), F.col("sizes.chosen")), 1),
            "avg_position": round_scaled(F.try_divide("positions", "placed"), 2),
            "intent_share": round_exact(percentage(F.col("intent"), F.col("sizes.intent")), 1),
        }
    )

    def rank(share: str) -> Column:
        return F.struct((-F.col(share)).alias("falling"), "ord", "brand_name", F.col(share).alias("share"))

    seeded = (F.col("ord") != UNLISTED) & (F.col("sizes.intent") > 0)
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_mentions"),
        F.min(rank("share")).alias("share"),
        F.min(F.when(F.col("placed") > 0, F.struct("avg_position", "brand_name"))).alias("position"),
        F.min(F.when(seeded, rank("intent_share"))).alias("stage"),
    )


def kpi_summary(facts: Facts, brands: DataFrame) -> DataFrame:
    """One row: ``total_mentions, top_brand, top_share, cited_sources``."""
    found = F.col("total_mentions") > 0
    return share_leader(facts, brands).select(
        "total_mentions",
        F.when(found, F.col("leader.brand_name")).otherwise("N/A").alias("top_brand"),
        F.when(found, F.concat(F.col("leader.share").cast("string"), F.lit("%"))).otherwise("0%").alias("top_share"),
        _domains(facts).agg(F.count("*")).scalar().alias("cited_sources"),
    )
