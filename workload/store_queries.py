"""The fact store over several runs, dimension files, catalog tables and the results of unusual rows."""

from __future__ import annotations

from uuid import uuid4

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.operators import dimensions as dims
from answerlens.operators import facts as fx
from answerlens.operators import metrics
from answerlens.operators.facts import Facts
from answerlens.operators.parsing import with_items
from answerlens.plans.insights import insight_report
from answerlens.plans.pipeline import run_pipeline
from answerlens.session import shared_folder
from answerlens.sources.dimensions import read_brands, read_prompts
from answerlens.sources.store import FactStore, create_tables, publish
from workload import ingest_queries as iq
from workload import maintenance_queries as mq
from workload import metric_queries as metric
from workload import standins as st

FACTS = ("responses", "mentions", "citations")


class Breaking(FactStore):
    """A store whose next attempts break when the mentions are due."""

    def _write(self, table, *args, **counts):
        if table == "mentions":
            raise RuntimeError("the run breaks here")
        return super()._write(table, *args, **counts)


def together(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows


def counts(store: FactStore) -> DataFrame:
    return together([store.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in FACTS])


def broken_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run, then a repetition, another run and a refresh that all break after the responses: the store is as it was."""
    store = iq.stored(spark, sf_dir)
    rows, brands = st.landing(spark, sf_dir), st.brand_table(spark, st.TEXT_BRANDS)
    for run_id, force in (("first", False), ("second", False), ("third", True)):
        try:
            run_pipeline(rows, brands, Breaking(spark, store.root), run_id, force=force)
        except RuntimeError:
            continue
        raise AssertionError("the run did not break")
    return counts(store)


def two_runs(spark: SparkSession, sf_dir: str) -> tuple[FactStore, DataFrame]:
    """A store after a run over the answers to users' turns, and a second run over all that skips what is there."""
    store, brands = iq.new_store(spark), st.brand_table(spark, st.TEXT_BRANDS)
    rows = st.landing(spark, sf_dir)
    run_pipeline(rows.filter("platform = 'user'"), brands, store, "first")
    return store, run_pipeline(rows, brands, store, "second", skip_existing=True)


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are unique, and those of a later run go on from the earlier one's, as the table of runs has them."""
    store, _ = two_runs(spark, sf_dir)
    parts = []
    for t in FACTS:
        last = store.runs.filter("run_id = 'first'").agg(F.max(f"last_{t}")).scalar()
        later = store.before_run(t, "first").agg(F.min("id")).scalar()
        parts.append(
            store.table(t).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), (F.coalesce(later, last + 1) > last).alias("goes_on"))
            .select(F.lit(t).alias("table_name"), "n", "n_ids", "goes_on")
        )
    return together(parts)


def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of assistants with sources are deleted from a store of two runs; the run of users' turns keeps its files."""
    store, _ = two_runs(spark, sf_dir)
    before = store.standing().select("run_id", F.col("attempt").alias("was")).collect()
    keys = st.landing(spark, sf_dir).filter("size(citations) > 0").select("prompt_id", "platform")
    store.delete_responses(keys)
    was = spark.createDataFrame(before, "run_id string, was string")
    kept = store.standing().join(was, "run_id").filter("attempt = was").agg(F.count("*")).scalar()
    return counts(store).withColumn("runs_untouched", kept)


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One UTC stamp for all answers of a run, not before the run began."""
    begun = spark.range(1).select(F.current_timestamp().alias("t")).first().t
    store, _ = two_runs(spark, sf_dir)
    rows = store.facts_of("responses", store.standing())
    return rows.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_distinct("timestamp").alias("n_stamps"), (F.min("timestamp") >= F.lit(begun)).alias("recent")
    )


def long_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run with all words and pairs of the benchmark as brands."""
    store = iq.new_store(spark)
    run_pipeline(st.landing(spark, sf_dir), iq.word_list(spark, sf_dir), store, "long")
    keys = store.responses.select(F.col("id").alias("response_id"), "prompt_id", "platform")
    return store.mentions.join(keys, "response_id").select("prompt_id", "platform", "brand_name", "position")


def blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed answers of which one in three is null or empty."""
    nothing = F.when(F.col("prompt_id") % 2 == 0, F.lit(""))
    return st.landing(spark, sf_dir).withColumn("raw_text", F.when(F.col("landing_id") % 3 == 0, nothing).otherwise(F.col("raw_text")))


def empty_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without text are not processed, whether they have an error or not."""
    store = iq.new_store(spark)
    stats = run_pipeline(blanked(spark, sf_dir), st.brand_table(spark, st.TEXT_BRANDS), store, "blank")
    return stats.select("total_prompts", "processed", "api_errors")


def empty_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed nevertheless, an answer without text names nobody and cites nothing, whatever sources came with it."""
    parsed = with_items(blanked(spark, sf_dir).filter("landing_id % 3 = 0"), brands=st.TEXT_BRANDS)
    return parsed.select("landing_id", F.size("mention_items").alias("n_mentions"), F.size("citation_items").alias("n_citations"))


def document_file(spark: SparkSession, rows: DataFrame, order: str, item: str) -> str:
    """Rows as one JSON array in one file, as dimension files are."""
    folder = f"{shared_folder(spark)}/dimension-{uuid4().hex}"
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.expr(item).alias("item")))).alias("rows"))
    listed.select(F.to_json(F.transform("rows", lambda r: r["item"])).alias("value")).coalesce(1).write.text(folder)
    return folder


def prompt_file(spark: SparkSession, sf_dir: str) -> str:
    return document_file(spark, mq.named_prompts(spark, sf_dir), "id", "struct(id, text, stage)")


def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A good, a blank, a missing, a cut and a wrong prompt file: rows read, or the error that tells them apart."""
    good = prompt_file(spark, sf_dir)
    texts = {"blank": F.lit(" "), "cut": F.substring("value", 1, 1000), "wrong": F.concat(F.lit("{"), F.substring("value", 2, 1000))}
    paths = {"good": good, "missing": f"{good}-missing"}
    for name, text in texts.items():
        paths[name] = f"{good}-{name}"
        spark.read.text(good, wholetext=True).select(text.alias("value")).write.text(paths[name])
    found = []
    for name, path in paths.items():
        try:
            found.append((name, read_prompts(spark, path).count(), False))
        except (PySparkException, Py4JError):
            found.append((name, None, True))
    return spark.createDataFrame(found, "file string, n long, failed boolean")


def bucketed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with the platform of their answer from bucketed catalog tables, joined without a shuffle."""
    database = f"visibility_{uuid4().hex}"
    create_tables(spark, database, 8)
    rows = Facts(
        st.responses(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp")),
        st.mentions(spark, sf_dir).withColumn("id", F.col("response_id") * 10 + F.col("position")),
        st.citations(spark, sf_dir).withColumn("id", F.lit(0).cast("long")),
    )
    publish(rows, database)
    answers = spark.table(f"{database}.responses").select(F.col("id").alias("response_id"), "platform")
    report = spark.table(f"{database}.mentions").join(answers.hint("merge"), "response_id").select("response_id", "platform", "brand_name", "position")
    plan = report._jdf.queryExecution().executedPlan().toString()
    return report.withColumn("shuffled", F.lit("Exchange" in plan or "SortMergeJoin" not in plan))


def unknown_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers per stage when all prompts have been deleted."""
    none = dims.delete_all(st.prompts(spark, sf_dir))
    found = fx.filtered_facts(st.responses(spark, sf_dir), st.mentions(spark, sf_dir), st.citations(spark, sf_dir), none, "unknown")
    return together([getattr(found, t).groupBy("stage").agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "stage", "n") for t in FACTS])


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares and counts after brands were renamed and deleted and prompts deleted: facts keep the names they were stored with."""
    renamed = dims.rename_brands(mq.brand_list(spark, sf_dir), mq.renames(spark, sf_dir)).result
    left = dims.delete_brands(renamed, renamed.filter("ord % 2 = 0").select("brand_name")).result
    prompts = dims.delete_prompts(mq.named_prompts(spark, sf_dir), mq.customers_below(spark, sf_dir).withColumnRenamed("prompt_id", "id")).result
    found = fx.filtered_facts(st.responses(spark, sf_dir), st.mentions(spark, sf_dir), st.citations(spark, sf_dir), prompts)
    share = metrics.mention_share(found, left)
    return share.filter("mention_count > 0").select("brand_name", "mention_count")


def quiet_insights(spark: SparkSession, sf_dir: str, platform: str | None, cited: bool = True) -> DataFrame:
    citations = st.citations(spark, sf_dir)
    tables = (st.responses(spark, sf_dir), st.mentions(spark, sf_dir), citations if cited else citations.filter(F.lit(False)), st.prompts(spark, sf_dir))
    return insight_report(*tables, st.brand_table(spark), None, platform)


QUERIES = {
    "broken_run_invisible": broken_run,
    "ids_across_runs": ids,
    "run_summary_skipping": lambda s, d: two_runs(s, d)[1],
    "delete_touched_runs": deleted,
    "run_timestamps": stamps,
    "pipeline_long_list": long_run,
    "empty_answers": empty_answers,
    "empty_texts": empty_texts,
    "prompt_file": lambda s, d: read_prompts(s, prompt_file(s, d)),
    "brand_file": lambda s, d: read_brands(s, document_file(s, mq.brand_list(s, d), "ord", "brand_name")),
    "prompt_file_states": file_states,
    "bucketed_report": bucketed_report,
    "unknown_stage": unknown_stages,
    "history_kept": history,
    "insights_without_mentions": lambda s, d: quiet_insights(s, d, "nowhere"),
    "insights_without_citations": lambda s, d: quiet_insights(s, d, None, cited=False),
}

COUNTS_SQL = """SELECT 'responses' AS table_name, count(*) AS n FROM good
UNION ALL SELECT 'mentions', count(*) FROM mentions UNION ALL SELECT 'citations', count(*) FROM cites"""
KEPT_SQL = """left_over AS (
  SELECT * FROM good WHERE NOT EXISTS (SELECT 1 FROM landing l WHERE l.has_sources AND l.prompt_id = good.prompt_id AND l.platform = good.platform))"""
LINES = metric.insights_sql()

ORACLES = {
    "broken_run_invisible": f"WITH {iq.GOOD_SQL} {COUNTS_SQL}",
    "ids_across_runs": f"WITH {iq.GOOD_SQL} SELECT table_name, n, n AS n_ids, true AS goes_on FROM ({COUNTS_SQL})",
    "run_summary_skipping": f"""WITH {iq.GOOD_SQL}, new AS (SELECT * FROM good WHERE platform <> 'user'),
skip AS (
  SELECT * FROM landing l WHERE EXISTS (SELECT 1 FROM good g WHERE g.platform = 'user' AND g.platform = l.platform AND g.prompt_id = l.prompt_id))
SELECT (SELECT count(*) FROM landing) AS total_prompts, (SELECT count(*) FROM new) AS processed, (SELECT count(*) FROM skip) AS skipped,
       (SELECT count(*) FROM landing) - (SELECT count(*) FROM new) - (SELECT count(*) FROM skip) AS api_errors,
       (SELECT count(*) FROM mentions JOIN new ON response_id = landing_id) AS total_mentions,
       (SELECT count(*) FROM cites JOIN new ON response_id = landing_id) AS total_citations,
       (SELECT count(*) FROM cites JOIN new ON response_id = landing_id WHERE has_sources) AS grounded_citations,
       (SELECT count(*) FROM cites JOIN new ON response_id = landing_id WHERE NOT has_sources) AS fallback_citations""",
    "delete_touched_runs": f"""WITH {iq.GOOD_SQL}, {KEPT_SQL}
SELECT 'responses' AS table_name, count(*) AS n, CAST(1 AS BIGINT) AS runs_untouched FROM left_over
UNION ALL SELECT 'mentions', count(*), 1 FROM mentions JOIN left_over ON response_id = landing_id
UNION ALL SELECT 'citations', count(*), 1 FROM cites JOIN left_over ON response_id = landing_id""",
    "run_timestamps": f"""WITH {iq.GOOD_SQL}
SELECT CASE WHEN platform = 'user' THEN 'first' ELSE 'second' END AS run_id, count(*) AS n, CAST(1 AS BIGINT) AS n_stamps, true AS recent
FROM good GROUP BY 1""",
    "pipeline_long_list": f"""WITH {st.LANDING_SQL},
good AS (SELECT * FROM landing WHERE error IS NULL AND coalesce(raw_text, '') <> ''),
{iq.NAMES_SQL}, {iq.tokens_sql('good', 'landing_id', 'raw_text')}
SELECT prompt_id, platform, brand_name,
       CAST(row_number() OVER (PARTITION BY id ORDER BY first_index, brand_name) AS INT) AS position
FROM found JOIN good ON id = landing_id""",
    "empty_answers": f"""WITH {st.LANDING_SQL}
SELECT count(*) AS total_prompts, count(*) FILTER (WHERE error IS NULL AND landing_id % 3 <> 0 AND coalesce(raw_text, '') <> '') AS processed,
       count(*) FILTER (WHERE error IS NOT NULL OR landing_id % 3 = 0 OR coalesce(raw_text, '') = '') AS api_errors FROM landing""",
    "empty_texts": f"""WITH {st.LANDING_SQL}
SELECT landing_id, 0 AS n_mentions, 0 AS n_citations FROM landing WHERE landing_id % 3 = 0""",
    "prompt_file": f"SELECT c_custkey AS id, c_name AS text, {st.sql_choose('c_mktsegment', st.SEGMENT_STAGES)} AS stage FROM customer",
    "brand_file": "SELECT CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS INT) AS ord, p_brand AS brand_name FROM part GROUP BY p_brand",
    "prompt_file_states": """SELECT 'good' AS file, count(*) AS n, false AS failed FROM customer
UNION ALL SELECT 'blank', 0, false UNION ALL SELECT 'missing', 0, false
UNION ALL SELECT 'cut', NULL, true UNION ALL SELECT 'wrong', NULL, true""",
    "bucketed_report": f"""WITH {st.RESPONSES_SQL}, {st.MENTIONS_SQL}
SELECT response_id, platform, brand_name, CAST(position AS INT) AS position, false AS shuffled FROM mentions JOIN responses ON response_id = id""",
    "unknown_stage": """SELECT 'responses' AS table_name, 'unknown' AS stage, count(*) AS n FROM orders
UNION ALL SELECT 'mentions', 'unknown', count(*) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'citations', 'unknown', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "history_kept": f"""WITH {st.MENTIONS_SQL}
SELECT brand_name, count(DISTINCT response_id) AS mention_count FROM mentions JOIN orders ON response_id = o_orderkey GROUP BY brand_name""",
    "insights_without_mentions": """SELECT 1 AS seq, 'No brand mention data available yet. Run the pipeline to generate insights.' AS insight
FROM region WHERE r_regionkey = 0""",
    "insights_without_citations": f"""SELECT seq, CASE WHEN seq = 3 THEN '**Citation Profile**: Gemini responses primarily rely on parametric memory '
  || 'without explicit external markdown URL citations.' ELSE insight END AS insight FROM ({LINES})""",
}
