"""Model tables derived from the given tables, as DataFrames and as SQL common table expressions.

Every table below is read whole.

prompts    customers in good standing; the others count as deleted prompts. Stage by market segment.
responses  orders; the customer is the prompt, the status the platform.
mentions   line items; the brand of the part, the line number as position, the return flag as sentiment.
citations  line items; a URL per supplier and line number.
documents  answer texts.
pages      answer texts with plain and markdown links around the whole page source.
landing    conversation turns with the page of the same number as the consulted source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.functions.urls import domain
from answerlens.schemas import BRANDS

SEGMENT_STAGES = {
    "AUTOMOBILE": "research",
    "BUILDING": "comparison",
    "FURNITURE": "recommendation",
    "HOUSEHOLD": "problem_solving",
    "MACHINERY": "vendor_selection",
}
FLAG_SENTIMENTS = {"A": "recommended", "N": "neutral", "R": "negative"}
SEED_BRANDS = ("Brand#1", "Brand#2", "Brand#3", "Brand#99")
PLATFORMS = ("F", "O", "P")

# Words the invented prose of the documents holds, as brands and as sentiment keywords.
TEXT_BRANDS = ("the", "Der", "une", "of the", "tion", "Que la", "Enerst", "thor", "HubSpot")
TEXT_POSITIVE = ("that", "with", "best", "und", "les")
TEXT_NEGATIVE = ("for", "ing", "die", "que", "los")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(value: Column, choices: dict[str, str]) -> Column:
    chosen = F.lit(None).cast("string")
    for key, result in choices.items():
        chosen = F.when(value == key, result).otherwise(chosen)
    return chosen


def sql_choose(value: str, choices: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{key}' THEN '{result}'" for key, result in choices.items())
    return f"CASE {value} {whens} END"


def brand_table(spark: SparkSession, names: Sequence[str] = SEED_BRANDS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), BRANDS)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    return customers.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("text"),
        choose(F.col("c_mktsegment"), SEGMENT_STAGES).alias("stage"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("prompt_id"),
        F.col("o_orderstatus").alias("platform"),
        F.col("o_orderpriority").alias("raw_text"),
        F.col("o_orderdate").alias("timestamp"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("response_id"),
        F.col("p_brand").alias("brand_name"),
        F.col("l_linenumber").alias("position"),
        choose(F.col("l_returnflag"), FLAG_SENTIMENTS).alias("sentiment"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://www.Supplier-"), "l_suppkey", F.lit(".com:80/"), "l_linenumber")
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("response_id"), url.alias("source_url"))
        .withColumn("source_domain", domain(F.col("source_url")))
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("platform"), F.col("text").alias("raw_text")
    )


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("See "), "url", F.lit("., then [src](www.here.org) and [x]("), "url", F.lit(").\n[w]("),
        "url", F.lit("_(y)) "), "html",
    )
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", text.alias("raw_text"))


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    url = F.col("url")

    def source(link: Column, title: Column) -> Column:
        return F.struct(link.cast("string").alias("url"), title.cast("string").alias("title"))

    sources = F.array(
        source(url, F.lit("Page")),
        source(F.lit(None), F.concat(F.lit("  Guide "), "page_id")),
        source(url, F.lit("Again")),
        source(F.lit(None), F.lit(None)),
    )
    assistant = F.col("role") == "assistant"
    return turns.join(pages, turns.conv_id == pages.page_id, "left").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("landing_id"),
        F.col("conv_id").alias("prompt_id"),
        F.col("role").alias("platform"),
        F.when(assistant, F.col("text"))
        .otherwise(F.concat("text", F.lit(" More at "), F.coalesce("url", F.lit("http://none.org")), F.lit(".")))
        .alias("raw_text"),
        F.when(assistant & url.isNotNull(), sources)
        .otherwise(F.array().cast("array<struct<url:string,title:string>>"))
        .alias("citations"),
        (assistant | (F.col("role") == "system")).alias("grounded"),
        F.when(F.col("role") == "system", "429 RESOURCE_EXHAUSTED GenerateRequestsPerDay").alias("error"),
    )


PROMPTS_SQL = f"""prompts AS (
  SELECT c_custkey AS id, c_name AS text, {sql_choose('c_mktsegment', SEGMENT_STAGES)} AS stage
  FROM customer WHERE c_acctbal >= 0)"""
RESPONSES_SQL = """responses AS (
  SELECT o_orderkey AS id, o_custkey AS prompt_id, o_orderstatus AS platform, o_orderpriority AS raw_text
  FROM orders)"""
MENTIONS_SQL = f"""mentions AS (
  SELECT l_orderkey AS response_id, p_brand AS brand_name, l_linenumber AS position,
         {sql_choose('l_returnflag', FLAG_SENTIMENTS)} AS sentiment
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
CITATIONS_SQL = """citations AS (
  SELECT l_orderkey AS response_id,
         'https://www.Supplier-' || l_suppkey || '.com:80/' || l_linenumber AS source_url,
         'supplier-' || l_suppkey || '.com' AS source_domain
  FROM lineitem)"""
MODEL_SQL = ",\n".join([PROMPTS_SQL, RESPONSES_SQL, MENTIONS_SQL, CITATIONS_SQL])

LINKED_PAGES_SQL = """linked AS (
  SELECT page_id AS id, url, 'See ' || url || '., then [src](www.here.org) and [x](' || url || ').' || chr(10)
         || '[w](' || url || '_(y)) ' || html AS raw_text
  FROM pages)"""
LANDING_SQL = """landing AS (
  SELECT conv_id * 1000 + turn AS landing_id, conv_id AS prompt_id, role AS platform, url, page_id,
         CASE WHEN role = 'assistant' THEN text
              ELSE text || ' More at ' || coalesce(url, 'http://none.org') || '.' END AS raw_text,
         role = 'assistant' AND url IS NOT NULL AS has_sources,
         role IN ('assistant', 'system') AS grounded,
         CASE WHEN role = 'system' THEN '429 RESOURCE_EXHAUSTED GenerateRequestsPerDay' END AS error
  FROM conversations LEFT JOIN pages ON conv_id = page_id)"""


def sql_values(names: Sequence[str]) -> str:
    rows = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"(VALUES {rows}) AS v(ord, brand_name)"


SEEDS_SQL = f"seeds AS (SELECT * FROM {sql_values(SEED_BRANDS)})"
