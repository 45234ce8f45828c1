"""Extraction from answer texts: whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.functions import urls
from answerlens.functions import text as tx
from answerlens.lexicon import NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS
from answerlens.operators.citations import extract_citations
from answerlens.operators.mentions import extract_mentions, located_brands
from workload import standins as st

# RE2, the oracle's regex engine, has no lookarounds, so the neighbours of a match are spelled out.
NOT_WORD = r"[^\p{L}\p{N}_]"


def located_sql(name: str, order: int, table: str, key: str, text: str) -> str:
    """Texts that name one brand, with the index of the first whole-word occurrence."""
    word = name.lower()
    pattern = rf"(?s)^((?:.*?{NOT_WORD})??){word}(?:{NOT_WORD}|$)"
    return f"""SELECT {key} AS response_id, {text} AS text, '{name}' AS brand_name, {order} AS ord, {len(name)} AS w,
       length(regexp_extract(lower({text}), '{pattern}', 1)) AS i
  FROM {table} WHERE regexp_matches(lower({text}), '(?:^|{NOT_WORD}){word}(?:{NOT_WORD}|$)')"""


def contexts_sql(table: str, key: str, text: str, brands=st.TEXT_BRANDS) -> str:
    """Common table expressions ``located`` and ``contexts`` over the texts of a table."""
    located = "\nUNION ALL ".join(located_sql(b, i, table, key, text) for i, b in enumerate(brands))
    return rf"""located AS (
{located}),
around AS (
  SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY i, ord) AS position,
         substring(text, greatest(i - 100, 0) + 1, least(i, 100)) AS b, substring(text, i + w + 1, 100) AS f
  FROM located),
contexts AS (
  SELECT response_id, brand_name, position, i AS first_index,
         CASE WHEN regexp_matches(b, '[.\n]') THEN regexp_extract(b, '[^.\n]*$') ELSE right(b, 80) END
         || substring(text, i + 1, w)
         || CASE WHEN regexp_matches(f, '[.\n]') THEN regexp_extract(f, '^[^.\n]*[.\n]') ELSE left(f, 80) END
           AS context
  FROM around)"""


CONTEXTS_SQL = contexts_sql("documents", "doc_id", "text")


def score_sql(keywords) -> str:
    return " + ".join(f"CAST(contains(lower(context), '{k}') AS INT)" for k in keywords)


def label_sql(positive, negative) -> str:
    good, bad = score_sql(positive), score_sql(negative)
    return f"CASE WHEN {good} > {bad} THEN 'recommended' WHEN {bad} > {good} THEN 'negative' ELSE 'neutral' END"


def listed(*columns: str):
    return lambda s, d: located_brands(st.documents(s, d), st.TEXT_BRANDS).select(*columns)


def tuned_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_mentions(st.documents(spark, sf_dir), st.TEXT_BRANDS, st.TEXT_POSITIVE, st.TEXT_NEGATIVE)


def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.lower("raw_text")
    return st.documents(spark, sf_dir).select(
        "id",
        tx.keyword_score(lowered, st.TEXT_POSITIVE).alias("positive"),
        tx.keyword_score(lowered, st.TEXT_NEGATIVE).alias("negative"),
    )


def url_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = st.table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        urls.domain(F.col("url")).alias("domain"),
        urls.domain(F.regexp_replace("url", "^https?://", "www.")).alias("bare_domain"),
    )


def pages_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_citations(st.linked_pages(spark, sf_dir)).select("response_id", "source_url", "source_domain")


def bare_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = st.linked_pages(spark, sf_dir)
    found = pages.select("id", F.posexplode_outer(urls.bare_urls(F.col("raw_text"))).alias("at", "url"))
    return found.filter(F.col("url").isNotNull())


def markdown_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = st.linked_pages(spark, sf_dir)
    found = pages.select("id", F.posexplode_outer(urls.markdown_urls(F.col("raw_text"))).alias("at", "url"))
    return found.filter(F.col("url").isNotNull())


def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = st.landing(spark, sf_dir)
    items = F.posexplode_outer(urls.grounded_sources(F.col("citations"))).alias("at", "item")
    found = landed.select(F.col("landing_id").alias("response_id"), items)
    return found.filter(F.col("item").isNotNull()).select("response_id", "at", "item.source_url", "item.source_domain")


def switched(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = st.landing(spark, sf_dir)
    return extract_citations(landed, "landing_id", "raw_text", "citations").select(
        "response_id", "source_url", "source_domain"
    )


def sql_domain(url: str) -> str:
    return f"lower(regexp_extract({url}, '^(?:https?://)?(?:www\\.)?([^/?#:]*)', 1))"


def sql_bare(text: str) -> str:
    return f"""list_transform(regexp_extract_all({text}, '{urls.URL}'), lambda z: rtrim(z, '{urls.TRAILING_PUNCTUATION}'))"""


def sql_markdown(text: str) -> str:
    return f"""list_filter(regexp_extract_all({text}, '{urls.MARKDOWN_LINK}', 2), lambda z: starts_with(z, 'http'))"""


def sql_text_sources(table: str, key: str) -> str:
    found = f"list_distinct(list_concat({sql_bare('raw_text')}, {sql_markdown('raw_text')}))"
    return f"""SELECT response_id, source_url, source_domain FROM (
  SELECT response_id, source_url, {sql_domain('source_url')} AS source_domain
  FROM (SELECT {key} AS response_id, unnest({found}) AS source_url FROM {table}))
WHERE source_domain <> ''"""


GROUNDED_SQL = f"""SELECT landing_id AS response_id, 0 AS "at", url AS source_url, {sql_domain('url')} AS source_domain
FROM landing WHERE has_sources
UNION ALL SELECT landing_id, 1, NULL, 'guide ' || page_id FROM landing WHERE has_sources"""


QUERIES = {
    "brand_first_index": listed("response_id", "brand_name", "first_index"),
    "brand_rank": listed("response_id", "brand_name", "position"),
    "context_window": listed("response_id", "brand_name", "context"),
    "keyword_scores": keyword_scores,
    "sentiment_label": lambda s, d: extract_mentions(st.documents(s, d), st.TEXT_BRANDS).select(
        "response_id", "brand_name", "sentiment"
    ),
    "parse_mentions": tuned_mentions,
    "url_domain": url_domains,
    "url_scan": bare_urls,
    "markdown_links": markdown_urls,
    "text_citations": pages_citations,
    "grounded_citations": grounded,
    "citation_source_switch": switched,
}

ORACLES = {
    "brand_first_index": f"""WITH {CONTEXTS_SQL}
SELECT response_id, brand_name, CAST(first_index AS INT) AS first_index FROM contexts""",
    "brand_rank": f"WITH {CONTEXTS_SQL} SELECT response_id, brand_name, CAST(position AS INT) AS position FROM contexts",
    "context_window": f"WITH {CONTEXTS_SQL} SELECT response_id, brand_name, context FROM contexts",
    "keyword_scores": f"""SELECT doc_id AS id, {score_sql(st.TEXT_POSITIVE)} AS positive,
       {score_sql(st.TEXT_NEGATIVE)} AS negative FROM (SELECT doc_id, text AS context FROM documents)""",
    "sentiment_label": f"""WITH {CONTEXTS_SQL}
SELECT response_id, brand_name, {label_sql(POSITIVE_KEYWORDS, NEGATIVE_KEYWORDS)} AS sentiment FROM contexts""",
    "parse_mentions": f"""WITH {CONTEXTS_SQL}
SELECT response_id, brand_name, CAST(position AS INT) AS position, {label_sql(st.TEXT_POSITIVE, st.TEXT_NEGATIVE)} AS sentiment FROM contexts""",
    "url_domain": f"""SELECT page_id, {sql_domain('url')} AS "domain",
       {sql_domain("regexp_replace(url, '^https?://', 'www.')")} AS bare_domain FROM pages""",
    "url_scan": f"""WITH {st.LINKED_PAGES_SQL}
SELECT id, CAST(generate_subscripts(found, 1) - 1 AS INT) AS "at", unnest(found) AS url
FROM (SELECT id, {sql_bare('raw_text')} AS found FROM linked)""",
    "markdown_links": f"""WITH {st.LINKED_PAGES_SQL}
SELECT id, CAST(generate_subscripts(found, 1) - 1 AS INT) AS "at", unnest(found) AS url
FROM (SELECT id, {sql_markdown('raw_text')} AS found FROM linked)""",
    "text_citations": f"WITH {st.LINKED_PAGES_SQL}\n{sql_text_sources('linked', 'id')}",
    "grounded_citations": f"WITH {st.LANDING_SQL}\n{GROUNDED_SQL}",
    "citation_source_switch": f"""WITH {st.LANDING_SQL}
SELECT response_id, source_url, source_domain FROM ({GROUNDED_SQL})
UNION ALL {sql_text_sources("(SELECT * FROM landing WHERE NOT has_sources)", "landing_id")}""",
}
