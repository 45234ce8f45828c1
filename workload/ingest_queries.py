"""Landed answers and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.lexicon import NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS
from answerlens.operators.dictionary import with_dictionary_hits
from answerlens.operators.facts import delete_responses
from answerlens.operators.parsing import summarize, with_items
from answerlens.plans.pipeline import parse_landing, run_pipeline
from answerlens.session import shared_folder
from answerlens.sources import answers as landed
from answerlens.sources.store import FactStore
from workload import standins as st
from workload import text_queries as tq


def answer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing rows as the model service would send them, with a second candidate."""
    rows = st.landing(spark, sf_dir)
    chunks = F.transform(
        "citations", lambda c: F.struct(F.struct(c.url.alias("uri"), c.title.alias("title")).alias("web"))
    )

    def part(text):
        return F.struct(text.alias("text"))

    def candidate(parts, grounding):
        return F.struct(
            F.struct(parts.alias("parts")).alias("content"),
            F.struct(grounding.alias("grounding_chunks")).alias("grounding_metadata"),
        )

    extra = F.array(
        F.struct(F.struct(F.lit("http://ignored.org").alias("uri"), F.lit("x").alias("title")).alias("web"))
    )
    first = candidate(F.array(part(F.col("raw_text")), part(F.lit(None).cast("string"))), chunks)
    second = candidate(F.array(part(F.lit("\n--")), part(F.col("platform"))), extra)
    document = F.to_json(F.struct(F.array(first, second).alias("candidates")))
    return rows.select("landing_id", "prompt_id", "platform", document.alias("answer"))


def grounding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = landed.parse_documents(answer_documents(spark, sf_dir))
    rows = parsed.select(F.col("landing_id").alias("response_id"), F.posexplode_outer("citations").alias("seq", "item"))
    return rows.filter(F.col("item").isNotNull()).select("response_id", "seq", "item.url", "item.title")


def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = landed.parse_documents(answer_documents(spark, sf_dir))
    return parsed.select("landing_id", "raw_text", "grounded")


def event_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as call failures: the type gives the kind of failure, the properties its details."""
    kinds = {"error": "429 daily limit ", "click": "429 PerMinute ", "view": "RESOURCE_EXHAUSTED PerDay ", "signup": "500 daily "}
    error = F.concat(F.coalesce(st.choose(F.col("event_type"), kinds), F.lit("")), "props")
    events = st.table(spark, sf_dir, "events").select("event_id", error.alias("error"))
    return events.withColumn("daily_quota_exhausted", landed.daily_quota_exhausted(F.col("error")))


def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.landing(spark, sf_dir).filter(~landed.usable()).select("landing_id", "error")


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.landing(spark, sf_dir).filter(landed.usable()).select("landing_id", "raw_text")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.landing(spark, sf_dir)
    parsed = parse_landing(rows, st.brand_table(spark, st.TEXT_BRANDS))
    return summarize(parsed, rows.agg(F.count("*")).scalar(), F.lit(0).cast("long"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of the landed answers, parsed row by row."""
    parsed = with_items(st.landing(spark, sf_dir).filter(landed.usable()), brands=st.TEXT_BRANDS)
    rows = parsed.select(F.col("landing_id").alias("response_id"), F.explode_outer("mention_items").alias("item"))
    return rows.filter(F.col("item").isNotNull()).select("response_id", "item.*")


def new_store(spark: SparkSession) -> FactStore:
    from uuid import uuid4

    return FactStore(spark, f"{shared_folder(spark)}/facts-{uuid4().hex}")


def stored(spark: SparkSession, sf_dir: str, twice: bool = False) -> FactStore:
    """A store after a run over the landed answers, and a second run that skips what is there."""
    store = new_store(spark)
    brands = st.brand_table(spark, st.TEXT_BRANDS)
    rows = st.landing(spark, sf_dir)
    run_pipeline(rows.filter("platform <> 'user'") if twice else rows, brands, store, "first", force=True)
    if twice:
        run_pipeline(rows, brands, store, "second", skip_existing=True)
    return store


def stored_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = stored(spark, sf_dir)
    keys = store.responses.select(F.col("id").alias("response_id"), "prompt_id", "platform")
    return store.mentions.join(keys, "response_id").select(
        "prompt_id", "platform", "brand_name", "position", "sentiment"
    )


def stored_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = stored(spark, sf_dir, twice=True)
    keys = store.responses.select(F.col("id").alias("response_id"), "prompt_id", "platform")
    return store.citations.join(keys, "response_id").select("prompt_id", "platform", "source_url", "source_domain")


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forced run over a store that already holds other runs leaves its own answers only."""
    store = stored(spark, sf_dir, twice=True)
    rows = st.landing(spark, sf_dir)
    return run_pipeline(rows, st.brand_table(spark, st.TEXT_BRANDS), store, "third", force=True)


def rerun(spark: SparkSession, sf_dir: str, fails: bool) -> DataFrame:
    """The only run of a store repeated, with a list that names nobody or with answers that all failed."""
    store = stored(spark, sf_dir)
    rows = st.landing(spark, sf_dir)
    brands = st.brand_table(spark, st.TEXT_BRANDS if fails else ("Nobody at all",))
    stats = run_pipeline(rows.withColumn("error", F.lit("quota")) if fails else rows, brands, store, "first")
    counts = {n: getattr(store, n).agg(F.count("*")).scalar() for n in ("responses", "mentions", "citations")}
    return stats.withColumns({f"{n}_stored": c for n, c in counts.items()})


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of pages' prompts deleted from a store, written as a new snapshot."""
    store, target = stored(spark, sf_dir), new_store(spark)
    keys = st.landing(spark, sf_dir).filter("size(citations) > 0").select("prompt_id", "platform").distinct()
    target.write_snapshot(delete_responses(store.responses, store.mentions, store.citations, keys))
    return target.responses.select("prompt_id", "platform", "raw_text")


def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long brand list: all words and all pairs of neighbouring words of all benchmark passages, none before another."""
    passages = st.table(spark, sf_dir, "benchmark").select(F.split(F.regexp_replace(F.lower("text"), "[.,]", ""), " ").alias("w"))
    pairs = F.transform("w", lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))
    names = passages.select(F.explode(F.concat("w", F.slice(pairs, 1, F.greatest(F.size("w") - 1, F.lit(0))))).alias("brand_name"))
    return names.filter(F.rlike("brand_name", F.lit(r"^[\p{L}\p{N}_]+( [\p{L}\p{N}_]+)?$"))).distinct().select(F.lit(0).alias("ord"), "brand_name")


def long_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First index of every brand of a long list in every document."""
    documents = st.documents(spark, sf_dir)
    hits = with_dictionary_hits(documents, word_list(spark, sf_dir), "id")
    rows = hits.select(F.col("id").alias("response_id"), F.explode_outer("hits").alias("hit"))
    return rows.filter(F.col("hit").isNotNull()).select("response_id", "hit.brand_name", "hit.first_index")


QUERIES = {
    "ingest_grounding_json": grounding_rows,
    "ingest_answer_text": answer_texts,
    "quota_error_flag": event_errors,
    "failed_answers": failed,
    "usable_answers": usable,
    "answer_items": items,
    "run_summary": summary,
    "pipeline_mentions": stored_mentions,
    "pipeline_citations_skip_existing": stored_citations,
    "full_refresh": refreshed,
    "rerun_without_mentions": lambda s, d: rerun(s, d, fails=False),
    "rerun_all_failed": lambda s, d: rerun(s, d, fails=True),
    "delete_snapshot": snapshot,
    "dictionary_first_index": long_list,
}

SOURCES_SQL = f"""WITH {st.LANDING_SQL}
SELECT landing_id AS response_id, 0 AS seq, url, 'Page' AS title FROM landing WHERE has_sources
UNION ALL SELECT landing_id, 1, NULL, '  Guide ' || page_id FROM landing WHERE has_sources
UNION ALL SELECT landing_id, 2, url, 'Again' FROM landing WHERE has_sources"""

GOOD_SQL = f"""{st.LANDING_SQL},
good AS (SELECT * FROM landing WHERE error IS NULL AND coalesce(raw_text, '') <> ''),
{tq.contexts_sql('good', 'landing_id', 'raw_text')},
mentions AS (
  SELECT response_id, brand_name, position, {tq.label_sql(POSITIVE_KEYWORDS, NEGATIVE_KEYWORDS)} AS sentiment
  FROM contexts),
cites AS (
  SELECT * FROM ({tq.GROUNDED_SQL.replace('FROM landing', 'FROM good')})
  UNION ALL SELECT response_id, 0, source_url, source_domain
  FROM ({tq.sql_text_sources('(SELECT * FROM good WHERE NOT has_sources)', 'landing_id')}))"""

SUMMARY_SQL = f"""WITH {GOOD_SQL}
SELECT (SELECT count(*) FROM landing) AS total_prompts, (SELECT count(*) FROM good) AS processed,
       CAST(0 AS BIGINT) AS skipped, (SELECT count(*) FROM landing) - (SELECT count(*) FROM good) AS api_errors,
       (SELECT count(*) FROM mentions) AS total_mentions, (SELECT count(*) FROM cites) AS total_citations,
       (SELECT count(*) FROM cites JOIN good ON response_id = landing_id WHERE has_sources) AS grounded_citations,
       (SELECT count(*) FROM cites JOIN good ON response_id = landing_id WHERE NOT has_sources) AS fallback_citations"""

# Names of the long list are words or pairs with one blank between. Whatever else is neither a word nor a blank is a comma
# here, so a word or pair is a token, or two that stand with one blank between them.
NAMES_SQL = r"""lists AS (SELECT string_split(regexp_replace(lower(text), '[.,]', '', 'g'), ' ') AS w FROM benchmark),
every AS (
  SELECT unnest(w) AS n FROM lists
  UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists),
names AS (SELECT DISTINCT n FROM every WHERE regexp_matches(n, '^[\p{L}\p{N}_]+( [\p{L}\p{N}_]+)?$'))"""


def tokens_sql(table: str, key: str, text: str) -> str:
    return rf"""marked AS (SELECT {key} AS id, regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}_ ]', ',', 'g') AS t FROM {table}),
cut AS (SELECT id, t, string_split_regex(t, '[ ,]') AS w FROM marked),
starts AS (
  SELECT id, t, unnest(w) AS token, unnest(list_transform(range(1, len(w) + 1), lambda i: i)) AS nth FROM cut),
placed AS (
  SELECT id, t, token, nth, coalesce(sum(length(token) + 1) OVER (PARTITION BY id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
         lead(token) OVER (PARTITION BY id ORDER BY nth) AS after FROM starts),
sequences AS (
  SELECT id, token AS n, p FROM placed WHERE token <> ''
  UNION ALL SELECT id, token || ' ' || after, p FROM placed
  WHERE token <> '' AND after <> '' AND substring(t, CAST(p + length(token) + 1 AS INT), 1) = ' '),
found AS (SELECT id, n AS brand_name, CAST(min(p) AS INT) AS first_index FROM sequences JOIN names USING (n) GROUP BY id, n)"""


LONG_LIST_SQL = f"""WITH {NAMES_SQL}, {tokens_sql('documents', 'doc_id', 'text')}
SELECT id AS response_id, brand_name, first_index FROM found"""

ORACLES = {
    "dictionary_first_index": LONG_LIST_SQL,
    "ingest_grounding_json": SOURCES_SQL,
    "ingest_answer_text": f"""WITH {st.LANDING_SQL}
SELECT landing_id, raw_text || chr(10) || '--' || platform AS raw_text, true AS grounded FROM landing""",
    "quota_error_flag": """WITH e AS (
  SELECT event_id, CASE event_type WHEN 'error' THEN '429 daily limit ' WHEN 'click' THEN '429 PerMinute '
           WHEN 'view' THEN 'RESOURCE_EXHAUSTED PerDay ' WHEN 'signup' THEN '500 daily ' ELSE '' END || props AS error
  FROM events)
SELECT event_id, error, regexp_matches(error, 'RESOURCE_EXHAUSTED|429')
       AND regexp_matches(error, 'PerDay|per_day|RequestsPerDay|daily') AS daily_quota_exhausted FROM e""",
    "failed_answers": f"""WITH {st.LANDING_SQL}
SELECT landing_id, error FROM landing WHERE error IS NOT NULL OR coalesce(raw_text, '') = ''""",
    "usable_answers": f"""WITH {st.LANDING_SQL}
SELECT landing_id, raw_text FROM landing WHERE error IS NULL AND coalesce(raw_text, '') <> ''""",
    "answer_items": f"WITH {GOOD_SQL} SELECT response_id, brand_name, CAST(position AS INT) AS position, sentiment FROM mentions",
    "run_summary": SUMMARY_SQL,
    "pipeline_mentions": f"""WITH {GOOD_SQL}
SELECT prompt_id, platform, brand_name, CAST(position AS INT) AS position, sentiment
FROM mentions JOIN good ON response_id = landing_id""",
    "pipeline_citations_skip_existing": f"""WITH {GOOD_SQL}
SELECT prompt_id, platform, source_url, source_domain FROM cites JOIN good ON response_id = landing_id""",
    "full_refresh": SUMMARY_SQL,
    "rerun_without_mentions": f"""SELECT * REPLACE (CAST(0 AS BIGINT) AS total_mentions), processed AS responses_stored,
       CAST(0 AS BIGINT) AS mentions_stored, total_citations AS citations_stored FROM ({SUMMARY_SQL})""",
    "rerun_all_failed": f"""SELECT total_prompts, total_prompts AS api_errors, CAST(0 AS BIGINT) AS processed,
       CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS total_mentions, CAST(0 AS BIGINT) AS total_citations,
       CAST(0 AS BIGINT) AS grounded_citations, CAST(0 AS BIGINT) AS fallback_citations,
       CAST(0 AS BIGINT) AS responses_stored, CAST(0 AS BIGINT) AS mentions_stored,
       CAST(0 AS BIGINT) AS citations_stored FROM ({SUMMARY_SQL})""",
    "delete_snapshot": f"""WITH {GOOD_SQL}
SELECT prompt_id, platform, raw_text FROM good
WHERE NOT EXISTS (SELECT 1 FROM landing l WHERE l.has_sources AND l.prompt_id = good.prompt_id
                  AND l.platform = good.platform)""",
}
