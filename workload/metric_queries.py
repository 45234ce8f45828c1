"""Visibility metrics over the relational stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.operators import facts as fx
from answerlens.operators import metrics
from answerlens.plans.insights import insight_report
from workload import standins as st


def model_facts(spark: SparkSession, sf_dir: str, stage: str | None = None, platform: str | None = None) -> fx.Facts:
    return fx.filtered_facts(
        st.responses(spark, sf_dir),
        st.mentions(spark, sf_dir),
        st.citations(spark, sf_dir),
        st.prompts(spark, sf_dir),
        stage,
        platform,
    )


def sql_facts(stage: str | None = None, platform: str | None = None, prefix: str = "") -> str:
    wanted = [f"stage = '{stage}'"] if stage else []
    wanted += [f"platform = '{platform}'"] if platform else []
    where = f"WHERE {' AND '.join(wanted)}" if wanted else ""
    return f"""{prefix}r AS (
  SELECT * FROM (
    SELECT responses.id, prompt_id, platform, raw_text, text,
           CASE WHEN (SELECT count(*) FROM prompts) = 0 THEN 'unknown' ELSE stage END AS stage
    FROM responses LEFT JOIN prompts ON prompt_id = prompts.id) {where}),
{prefix}m AS (SELECT mentions.*, {prefix}r.stage, {prefix}r.platform FROM mentions JOIN {prefix}r ON response_id = {prefix}r.id),
{prefix}c AS (SELECT citations.*, {prefix}r.stage, {prefix}r.platform FROM citations JOIN {prefix}r ON response_id = {prefix}r.id)"""


SHARE_SQL = """share AS (
  SELECT brand_name, min(ord) AS ord, CAST(sum(n) AS BIGINT) AS mention_count,
         (SELECT count(DISTINCT prompt_id) FROM r) AS total_prompts,
         round_even(CAST(sum(n) AS DOUBLE) / (SELECT count(DISTINCT prompt_id) FROM r) * 100 * 10, 0) / 10
           AS mention_share_pct
  FROM (SELECT brand_name, 2147483647 AS ord, count(DISTINCT response_id) AS n FROM m GROUP BY brand_name
        UNION ALL SELECT brand_name, ord, 0 FROM seeds)
  GROUP BY brand_name)"""
POSITION_SQL = """pos AS (
  SELECT brand_name, round_even(avg(position) * 100, 0) / 100 AS avg_position, count(position) AS mention_count
  FROM m GROUP BY brand_name)"""
DOMAIN_SQL = "dom AS (SELECT source_domain, count(*) AS citation_count FROM c GROUP BY source_domain)"


def stage_sql(prefix: str = "") -> str:
    return f"""stages AS (
  SELECT t.stage, seeds.ord, seeds.brand_name,
         coalesce(CAST(printf('%.1f', CAST(coalesce(n, 0) AS DOUBLE) / prompts * 100) AS DOUBLE), 0) AS mention_share_pct
  FROM (SELECT stage, count(DISTINCT prompt_id) AS prompts FROM {prefix}r GROUP BY stage) t CROSS JOIN seeds
  LEFT JOIN (SELECT stage, brand_name, count(DISTINCT response_id) AS n FROM {prefix}m GROUP BY stage, brand_name) k
    ON k.stage = t.stage AND k.brand_name = seeds.brand_name)"""


def with_model(stage: str | None = None, platform: str | None = None) -> str:
    return f"WITH {st.MODEL_SQL},\n{st.SEEDS_SQL},\n{sql_facts(stage, platform)}"


def share_sql(stage: str | None = None, platform: str | None = None) -> str:
    return f"""{with_model(stage, platform)},
{SHARE_SQL}
SELECT brand_name, mention_count, total_prompts, mention_share_pct FROM share WHERE (SELECT count(*) FROM m) > 0"""


def mention_share(spark, sf_dir, stage=None, platform=None) -> DataFrame:
    return metrics.mention_share(model_facts(spark, sf_dir, stage, platform), st.brand_table(spark))


def stage_breakdown(spark, sf_dir, platform=None) -> DataFrame:
    return metrics.stage_breakdown(model_facts(spark, sf_dir, None, platform), st.brand_table(spark))


def stage_breakdown_sql(platform: str | None = None) -> str:
    return f"""{with_model(None, platform)},
{stage_sql()}
SELECT stage, brand_name, mention_share_pct FROM stages WHERE (SELECT count(*) FROM m) > 0"""


def all_insights(spark, sf_dir, stage=None, platform=None) -> DataFrame:
    tables = (st.responses, st.mentions, st.citations, st.prompts)
    return insight_report(*[t(spark, sf_dir) for t in tables], st.brand_table(spark), stage, platform)


def insights_sql(stage: str | None = None, platform: str | None = None) -> str:
    return f"""WITH {st.MODEL_SQL},
{st.SEEDS_SQL},
{sql_facts(stage, platform)},
{sql_facts(None, platform, 's')},
{SHARE_SQL},
{POSITION_SQL},
{DOMAIN_SQL},
{stage_sql('s')},
top AS (SELECT * FROM share ORDER BY mention_share_pct DESC, ord, brand_name LIMIT 1)
SELECT 1 AS seq, '**Brand Visibility Leader**: **' || brand_name || '** leads visibility with a **'
  || mention_share_pct || '% mention share** across queried prompts.' AS insight FROM top
UNION ALL (SELECT 2, '**Prime Recommendation Rank**: **' || brand_name
  || '** earns the highest average placement position (**#' || avg_position
  || '**), appearing earliest in generated recommendations.' FROM pos ORDER BY avg_position, brand_name LIMIT 1)
UNION ALL (SELECT 3, '**Dominant Citation Source**: Gemini relies heavily on **' || source_domain || '** ('
  || citation_count || ' citations) as an authority reference for this niche.'
  FROM dom ORDER BY citation_count DESC, source_domain LIMIT 1)
UNION ALL (SELECT 4, '**Funnel Stage Dynamics**: In the high-intent *Recommendation* stage, **' || brand_name
  || '** captures **' || mention_share_pct || '% share** of voice.'
  FROM stages WHERE stage = 'recommendation' ORDER BY mention_share_pct DESC, ord LIMIT 1)"""


def staged_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.responses_with_stage(st.responses(spark, sf_dir).drop("timestamp"), st.prompts(spark, sf_dir))


def stages_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_facts(spark, sf_dir).responses.select("stage").distinct()


def brand_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentioned = metrics.brand_responses(model_facts(spark, sf_dir))
    return metrics.brand_universe(mentioned, st.brand_table(spark))


QUERIES = {
    "mention_share": mention_share,
    "mention_share_by_stage_filter": lambda s, d: mention_share(s, d, stage="comparison"),
    "mention_share_by_platform_filter": lambda s, d: mention_share(s, d, platform="P"),
    "mention_share_empty_gate": lambda s, d: mention_share(s, d, platform="nowhere"),
    "avg_position": lambda s, d: metrics.average_position(model_facts(s, d)),
    "avg_position_filtered": lambda s, d: metrics.average_position(model_facts(s, d, "research", "O")),
    "sentiment_breakdown": lambda s, d: metrics.sentiment_breakdown(model_facts(s, d)),
    "citation_domains": lambda s, d: metrics.citation_domains(model_facts(s, d)),
    "citation_domains_filtered": lambda s, d: metrics.citation_domains(model_facts(s, d, "problem_solving", "F")),
    "stage_breakdown": stage_breakdown,
    "stage_breakdown_by_platform": lambda s, d: stage_breakdown(s, d, platform="O"),
    "kpi_summary": lambda s, d: metrics.kpi_summary(model_facts(s, d), st.brand_table(s)),
    "insights": all_insights,
    "insights_filtered": lambda s, d: all_insights(s, d, "vendor_selection", "F"),
    "total_prompts": lambda s, d: metrics.total_prompts(model_facts(s, d)),
    "brand_response_counts": lambda s, d: metrics.brand_responses(model_facts(s, d)),
    "brand_universe": brand_universe,
    "stages_present": stages_present,
    "responses_with_stage": staged_responses,
    "filtered_responses": lambda s, d: model_facts(s, d, "comparison", "P").responses,
    "filtered_mentions": lambda s, d: model_facts(s, d, "comparison", "P").mentions,
    "filtered_citations": lambda s, d: model_facts(s, d, "comparison", "P").citations,
}

ORACLES = {
    "mention_share": share_sql(),
    "mention_share_by_stage_filter": share_sql(stage="comparison"),
    "mention_share_by_platform_filter": share_sql(platform="P"),
    "mention_share_empty_gate": share_sql(platform="nowhere"),
    "avg_position": f"{with_model()}, {POSITION_SQL} SELECT * FROM pos",
    "avg_position_filtered": f"{with_model('research', 'O')}, {POSITION_SQL} SELECT * FROM pos",
    "sentiment_breakdown": f"""{with_model()}
SELECT brand_name, count(*) FILTER (WHERE sentiment = 'recommended') AS recommended,
       count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative
FROM m GROUP BY brand_name""",
    "citation_domains": f"{with_model()}, {DOMAIN_SQL} SELECT * FROM dom",
    "citation_domains_filtered": f"{with_model('problem_solving', 'F')}, {DOMAIN_SQL} SELECT * FROM dom",
    "stage_breakdown": stage_breakdown_sql(),
    "stage_breakdown_by_platform": stage_breakdown_sql(platform="O"),
    "kpi_summary": f"""{with_model()},
{SHARE_SQL}
SELECT (SELECT CAST(sum(mention_count) AS BIGINT) FROM share) AS total_mentions, brand_name AS top_brand,
       mention_share_pct || '%' AS top_share, (SELECT count(DISTINCT source_domain) FROM c) AS cited_sources
FROM share ORDER BY mention_share_pct DESC, ord, brand_name LIMIT 1""",
    "insights": insights_sql(),
    "insights_filtered": insights_sql("vendor_selection", "F"),
    "total_prompts": f"{with_model()} SELECT count(DISTINCT prompt_id) AS total_prompts FROM r",
    "brand_response_counts": f"""{with_model()}
SELECT brand_name, count(DISTINCT response_id) AS mention_count FROM m GROUP BY brand_name""",
    "brand_universe": f"{with_model()}, {SHARE_SQL} SELECT brand_name, ord, mention_count FROM share",
    "stages_present": f"{with_model()} SELECT DISTINCT stage FROM r",
    "responses_with_stage": f"{with_model()} SELECT id, prompt_id, platform, raw_text, text, stage FROM r",
    "filtered_responses": f"{with_model('comparison', 'P')} SELECT id, prompt_id, platform, stage FROM r",
    "filtered_mentions": f"{with_model('comparison', 'P')} SELECT * FROM m",
    "filtered_citations": f"{with_model('comparison', 'P')} SELECT * FROM c",
}
