"""Insight sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens import lexicon
from answerlens.operators import metrics
from answerlens.operators.facts import Facts, filtered_facts, is_filter


def _sentence(template: str, *values: Column) -> Column:
    return F.format_string(template, *[v.cast("string") for v in values])


# Fixed value: the stage the last insight is about.
INTENT_STAGE = "recommendation"


def insights(facts: Facts, brands: DataFrame, stage: str | None = None) -> DataFrame:
    """``seq, insight``: share leader, best position, top domain and leader of the recommendation stage.

    ``facts`` are those of all stages; all but the last insight look at ``stage``, if it is given. Without any mention
    there is one fallback line. Every leader is part of a one-row aggregate, so nothing is sorted or collected to find it.
    """
    cited = facts.citations.filter(F.col("stage") == stage) if is_filter(stage) else facts.citations
    domain_leader = metrics.domain_leader(Facts(facts.responses, facts.mentions, cited)).select("leader").scalar()
    leaders = metrics.leaders(facts, brands, stage, INTENT_STAGE).withColumn("domain", domain_leader)
    share, position, domain, stage = (F.col(c) for c in ("share", "position", "domain", "stage"))
    lines = F.array(
        _sentence(lexicon.INSIGHT_SHARE, share.brand_name, share.share),
        F.when(
            position.isNotNull(), _sentence(lexicon.INSIGHT_POSITION, position.brand_name, position.avg_position)
        ),
        F.when(
            domain.isNotNull(), _sentence(lexicon.INSIGHT_DOMAIN, domain.source_domain, domain.citation_count)
        ).otherwise(lexicon.INSIGHT_NO_DOMAIN),
        F.when(stage.isNotNull(), _sentence(lexicon.INSIGHT_STAGE, stage.brand_name, stage.share)),
    )
    fallback = F.array(F.lit(lexicon.INSIGHT_NOTHING))
    chosen = F.when(F.col("total_mentions") > 0, F.array_compact(lines)).otherwise(fallback)
    rows = leaders.select(F.posexplode_outer(chosen).alias("at", "insight"))
    return rows.select((F.col("at") + 1).alias("seq"), "insight")


def insight_report(
    responses: DataFrame,
    mentions: DataFrame,
    citations: DataFrame,
    prompts: DataFrame,
    brands: DataFrame,
    stage: str | None = None,
    platform: str | None = None,
) -> DataFrame:
    """Insights of the facts a stage and a platform select; the stage insight ignores the stage filter."""
    return insights(filtered_facts(responses, mentions, citations, prompts, None, platform), brands, stage)
