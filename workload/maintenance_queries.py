"""Keys, cascades, id allocation and dimension batches over the given tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.operators import dimensions as dims
from answerlens.operators import facts as fx
from answerlens.operators.ids import next_id, with_sequential_ids
from answerlens.session import shared_folder
from workload import standins as st

# Part types stand for stages; the other types are no stage at all.
TYPE_STAGES = {"ECONOMY": "Research ", "LARGE": "comparison", "MEDIUM": " RECOMMENDATION", "PROMO": "vendor_selection"}


def text_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.responses(spark, sf_dir).drop("timestamp")


def customers_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose prompts count as deleted."""
    return st.table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("prompt_id"))


def cascade(spark: SparkSession, sf_dir: str) -> fx.Facts:
    keys = customers_below(spark, sf_dir).withColumn("platform", F.lit("F"))
    return fx.delete_responses(
        text_responses(spark, sf_dir), st.mentions(spark, sf_dir), st.citations(spark, sf_dir), keys
    )


def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = cascade(spark, sf_dir)
    counts = [
        getattr(left, name).agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left")
        for name in ("responses", "mentions", "citations")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_responses(spark, sf_dir).filter("platform <> 'P'")


def cleared(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a stored dimension before and after all of them are deleted."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/dimension-{uuid4().hex}"
    rows.write.parquet(f"{folder}/before")
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/before")
    dims.delete_all(stored).write.parquet(f"{folder}/after")
    left = spark.read.schema(rows.schema).parquet(f"{folder}/after").agg(F.count("*")).scalar()
    return stored.agg(F.count("*").alias("rows_before")).select(
        F.lit(name).alias("table_name"), "rows_before", left.alias("rows_after")
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as prompt texts; names repeat a lot, in changing spelling."""
    text = F.when(F.col("p_size") > 30, F.upper("p_name")).otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    return st.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_size") == 1, " ").otherwise(text).alias("text"),
        F.coalesce(st.choose(F.col("p_type"), TYPE_STAGES), F.lit("other")).alias("stage"),
    )


def held_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts there are before a batch: one per part name, in capitals or, with an odd id, as a question."""
    named = st.table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    text = F.when(F.col("id") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("?")))
    return named.select("id", text.alias("text"), F.lit("research").alias("stage"))


PARTS_SQL = f"""parts AS (
  SELECT p_partkey AS seq,
         CASE WHEN p_size = 1 THEN ' ' WHEN p_size > 30 THEN upper(p_name) ELSE '  ' || p_name || ' ' END AS text,
         coalesce({st.sql_choose('p_type', TYPE_STAGES)}, 'other') AS stage
  FROM part),
held AS (
  SELECT min(p_partkey) AS id, CASE WHEN min(p_partkey) % 2 = 0 THEN upper(p_name) ELSE p_name || '?' END AS text,
         'research' AS stage FROM part GROUP BY p_name)"""
STAGE_LIST = "'research', 'comparison', 'recommendation', 'problem_solving', 'vendor_selection'"


def checked_sql(rows: str) -> str:
    return f"""SELECT *, lower(trim(text)) AS k,
         CASE WHEN trim(text) = '' THEN 'empty_text'
              WHEN lower(trim(stage)) NOT IN ({STAGE_LIST}) THEN 'invalid_stage' END AS bad FROM {rows}"""


ADD_PROMPTS_SQL = f"""WITH {PARTS_SQL},
checked AS ({checked_sql('parts')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k, bad IS NULL ORDER BY seq) AS rn FROM checked),
fresh AS (SELECT * FROM ranked WHERE bad IS NULL AND rn = 1 AND k NOT IN (SELECT lower(trim(text)) FROM held))"""


def brand_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands of all parts, in order of first part."""
    return st.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand_name")).agg(F.min("p_partkey").cast("int").alias("ord")).select(
        "ord", "brand_name"
    )


BRANDS_SQL = """brands AS (
  SELECT CAST(min(p_partkey) AS INT) AS ord, p_brand AS brand_name FROM part GROUP BY p_brand)"""


def brand_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and part name together; every combination repeats, some in capitals."""
    name = F.concat("p_brand", F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1)))
    spelled = F.when(F.col("p_size") > 25, F.upper(name)).when(F.col("p_size") < 3, F.lit("  ")).otherwise(name)
    return st.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_type") == "SMALL", F.col("p_brand")).otherwise(spelled).alias("brand_name"),
    )


BRAND_CANDIDATES_SQL = """candidates AS (
  SELECT p_partkey AS seq,
         CASE WHEN p_type = 'SMALL' THEN p_brand
              WHEN p_size > 25 THEN upper(p_brand || ' ' || split_part(p_name, ' ', 1))
              WHEN p_size < 3 THEN '  ' ELSE p_brand || ' ' || split_part(p_name, ' ', 1) END AS brand_name
  FROM part)"""


def named_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("text"),
        st.choose(F.col("c_mktsegment"), st.SEGMENT_STAGES).alias("stage"),
    )


def prompt_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update per order: the customer's prompt gets the text of the order's priority and date.

    Customers have many orders, so most rows repeat a prompt; equal texts collide; the customer of
    an urgent order keeps its own name; an order of unknown customers refers to no prompt.
    """
    urgent = F.col("o_orderpriority") == "1-URGENT"
    own = F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    text = F.when(urgent, own).otherwise(
        F.concat("o_orderpriority", F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    return st.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_totalprice") > 400000, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")).alias("id"),
        text.alias("text"),
        F.when(F.col("o_orderstatus") == "P", "comparison").when(
            F.col("o_orderpriority") == "5-LOW", "nonsense"
        ).otherwise(" Research").alias("stage"),
    )


UPDATE_PROMPTS_SQL = f"""WITH existing AS (
  SELECT c_custkey AS id, c_name AS text, {st.sql_choose('c_mktsegment', st.SEGMENT_STAGES)} AS stage FROM customer),
batch AS (
  SELECT o_orderkey AS seq, CASE WHEN o_totalprice > 400000 THEN -o_custkey - 1 ELSE o_custkey END AS id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
              ELSE o_orderpriority || ' ' || strftime(o_orderdate, '%Y-%m-%d') END AS text,
         CASE WHEN o_orderstatus = 'P' THEN 'comparison' WHEN o_orderpriority = '5-LOW' THEN 'nonsense'
              ELSE ' Research' END AS stage
  FROM orders),
checked AS ({checked_sql('batch')}),
slots AS (SELECT id, row_number() OVER (ORDER BY id) AS slot, lower(trim(text)) AS k FROM existing),
valid AS (
  SELECT checked.*, coalesce(slot, 0) AS slot, row_number() OVER (ORDER BY seq) AS n
  FROM checked LEFT JOIN slots USING (id) WHERE bad IS NULL),
-- One row after the other: a list of the texts as they are, and the outcome of each row so far.
run AS (
  SELECT list_reduce(
    list_prepend(
      {{'slot': 0::BIGINT, 'k': '', 'texts': (SELECT list(k ORDER BY slot) FROM slots), 'outcomes': []::TINYINT[]}},
      (SELECT list({{'slot': slot::BIGINT, 'k': k, 'texts': []::VARCHAR[], 'outcomes': []::TINYINT[]}} ORDER BY n) FROM valid)),
    lambda a, e: {{'slot': 0::BIGINT, 'k': '',
      'texts': CASE WHEN e.slot > 0 AND (a.texts[e.slot] = e.k OR NOT list_contains(a.texts, e.k))
                    THEN a.texts[1:e.slot - 1] || [e.k] || a.texts[e.slot + 1:] ELSE a.texts END,
      'outcomes': a.outcomes || [CASE WHEN e.slot > 0 AND a.texts[e.slot] = e.k THEN 1 WHEN list_contains(a.texts, e.k) THEN 2
                                      WHEN e.slot = 0 THEN 3 ELSE 1 END::TINYINT]}}) AS done),
outcomes AS (SELECT unnest(done.outcomes) AS outcome, generate_subscripts(done.outcomes, 1) AS n FROM run),
judged AS (
  SELECT checked.*, CASE WHEN checked.bad IS NOT NULL THEN checked.bad WHEN outcome = 2 THEN 'duplicate' WHEN outcome = 3 THEN 'not_found' END AS why
  FROM checked LEFT JOIN valid USING (seq) LEFT JOIN outcomes USING (n)),
standing AS (SELECT * FROM judged WHERE why IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"""


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rename per supplier: brands by number, to names that are new, taken or only differ in case."""
    number = F.col("s_nationkey") + 1
    old = F.concat(F.lit(" brand#"), number)
    new = (
        F.when(F.col("s_acctbal") < 0, F.concat(F.lit("BRAND#"), number))
        .when(F.col("s_acctbal") < 2000, F.concat(F.lit("Brand#"), number + 1))
        .when(F.col("s_acctbal") < 3000, F.lit(" "))
        .otherwise(F.concat(F.lit("Label "), (number / 2).cast("int")))
    )
    return st.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("seq"), old.alias("old_name"), new.alias("new_name")
    )


RENAME_SQL = f"""WITH {BRANDS_SQL},
batch AS (
  SELECT s_suppkey AS seq, ' brand#' || (s_nationkey + 1) AS old_name,
         CASE WHEN s_acctbal < 0 THEN 'BRAND#' || (s_nationkey + 1)
              WHEN s_acctbal < 2000 THEN 'Brand#' || (s_nationkey + 2)
              WHEN s_acctbal < 3000 THEN ' '
              ELSE 'Label ' || ((s_nationkey + 1) // 2) END AS new_name
  FROM supplier),
checked AS (SELECT *, lower(trim(old_name)) AS o, lower(trim(new_name)) AS k,
                   CASE WHEN trim(new_name) = '' THEN 'empty_name' END AS bad FROM batch),
valid AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM checked WHERE bad IS NULL),
-- One row after the other: a list of the names as they are, and the outcome of each row so far.
run AS (
  SELECT list_reduce(
    list_prepend(
      {{'o': '', 'k': '', 'label': '', 'names': (SELECT list(brand_name ORDER BY ord) FROM brands), 'outcomes': []::TINYINT[]}},
      (SELECT list({{'o': o, 'k': k, 'label': trim(new_name), 'names': []::VARCHAR[], 'outcomes': []::TINYINT[]}} ORDER BY n) FROM valid)),
    lambda a, e: {{'o': '', 'k': '', 'label': '',
      'names': CASE WHEN e.o = e.k OR NOT list_contains(list_transform(a.names, lambda x: lower(x)), e.k)
                    THEN list_transform(a.names, lambda x: CASE WHEN lower(x) = e.o THEN e.label ELSE x END) ELSE a.names END,
      'outcomes': a.outcomes || [CASE WHEN NOT list_contains(list_transform(a.names, lambda x: lower(x)), e.o) THEN 3
                                      WHEN e.o <> e.k AND list_contains(list_transform(a.names, lambda x: lower(x)), e.k) THEN 2
                                      ELSE 1 END::TINYINT]}}) AS done),
outcomes AS (SELECT unnest(done.outcomes) AS outcome, generate_subscripts(done.outcomes, 1) AS n FROM run),
judged AS (
  SELECT checked.*, CASE WHEN checked.bad IS NOT NULL THEN checked.bad WHEN outcome = 2 THEN 'duplicate' WHEN outcome = 3 THEN 'not_found' END AS why
  FROM checked LEFT JOIN valid USING (seq) LEFT JOIN outcomes USING (n)),
named AS (SELECT unnest((SELECT list(ord ORDER BY ord) FROM brands)) AS ord, unnest((SELECT done.names FROM run)) AS brand_name)"""


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders appended to the finished ones as new responses."""
    stored = completed(spark, sf_dir)
    new = text_responses(spark, sf_dir).filter("platform = 'P'").withColumnRenamed("id", "landing_id")
    return with_sequential_ids(new, "landing_id", next_id(stored)).select("id", "prompt_id", "platform", "raw_text")


QUERIES = {
    "latest_response": lambda s, d: fx.latest_responses(text_responses(s, d)),
    "cascade_delete": lambda s, d: cascade(s, d).mentions,
    "cascade_delete_counts": cascade_counts,
    "orphan_check": lambda s, d: fx.orphans(st.mentions(s, d), completed(s, d)),
    "enforce_references": lambda s, d: fx.enforce_references(st.citations(s, d), completed(s, d)),
    "existence_prompts": lambda s, d: dims.prompts_with_responses(named_prompts(s, d), completed(s, d)),
    "existence_brands": lambda s, d: dims.brands_with_mentions(
        brand_candidates(s, d).select("seq", "brand_name"), st.mentions(s, d)
    ),
    "append_with_ids": appended,
    "add_prompts": lambda s, d: dims.add_prompts(held_prompts(s, d), parts(s, d)).result,
    "add_prompts_rejected": lambda s, d: dims.add_prompts(held_prompts(s, d), parts(s, d)).rejected,
    "update_prompts": lambda s, d: dims.update_prompts(named_prompts(s, d), prompt_updates(s, d)).result,
    "update_prompts_rejected": lambda s, d: dims.update_prompts(named_prompts(s, d), prompt_updates(s, d)).rejected,
    "delete_prompts": lambda s, d: dims.delete_prompts(
        named_prompts(s, d), customers_below(s, d).withColumnRenamed("prompt_id", "id")
    ).result,
    "delete_prompts_not_found": lambda s, d: dims.delete_prompts(
        st.prompts(s, d), customers_below(s, d).withColumnRenamed("prompt_id", "id")
    ).rejected,
    "delete_all_prompts": lambda s, d: cleared(named_prompts(s, d), "prompts"),
    "delete_all_brands": lambda s, d: cleared(brand_list(s, d), "brands"),
    "add_brands": lambda s, d: dims.add_brands(brand_list(s, d), brand_candidates(s, d)).result,
    "add_brands_rejected": lambda s, d: dims.add_brands(brand_list(s, d), brand_candidates(s, d)).rejected,
    "rename_brands": lambda s, d: dims.rename_brands(brand_list(s, d), renames(s, d)).result,
    "rename_brands_rejected": lambda s, d: dims.rename_brands(brand_list(s, d), renames(s, d)).rejected,
    "delete_brands": lambda s, d: dims.delete_brands(
        brand_list(s, d), renames(s, d).select(F.col("new_name").alias("brand_name"))
    ).result,
    "delete_brands_not_found": lambda s, d: dims.delete_brands(
        brand_list(s, d), renames(s, d).select(F.col("new_name").alias("brand_name"))
    ).rejected,
}

BELOW_SQL = "below AS (SELECT c_custkey AS prompt_id FROM customer WHERE c_acctbal < 0)"
DOOMED_SQL = f"""{BELOW_SQL},
doomed AS (SELECT id FROM responses WHERE platform = 'F' AND prompt_id IN (SELECT prompt_id FROM below))"""

ORACLES = {
    "latest_response": f"""WITH {st.RESPONSES_SQL}
SELECT id, prompt_id, platform, raw_text FROM responses
QUALIFY row_number() OVER (PARTITION BY prompt_id, platform ORDER BY id DESC) = 1""",
    "cascade_delete": f"""WITH {st.RESPONSES_SQL}, {st.MENTIONS_SQL}, {DOOMED_SQL}
SELECT * FROM mentions WHERE response_id NOT IN (SELECT id FROM doomed)""",
    "cascade_delete_counts": f"""WITH {st.RESPONSES_SQL}, {st.MENTIONS_SQL}, {st.CITATIONS_SQL}, {DOOMED_SQL}
SELECT 'responses' AS table_name, count(*) AS rows_left FROM responses WHERE id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'mentions', count(*) FROM mentions WHERE response_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'citations', count(*) FROM citations WHERE response_id NOT IN (SELECT id FROM doomed)""",
    "orphan_check": f"""WITH {st.RESPONSES_SQL}, {st.MENTIONS_SQL}
SELECT * FROM mentions WHERE response_id NOT IN (SELECT id FROM responses WHERE platform <> 'P')""",
    "enforce_references": f"""WITH {st.RESPONSES_SQL}, {st.CITATIONS_SQL}
SELECT * FROM citations WHERE response_id IN (SELECT id FROM responses WHERE platform <> 'P')""",
    "existence_prompts": f"""SELECT c_custkey AS id, c_name AS text,
       {st.sql_choose('c_mktsegment', st.SEGMENT_STAGES)} AS stage,
       c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P') AS has_responses FROM customer""",
    "existence_brands": f"""WITH {BRAND_CANDIDATES_SQL}, {st.MENTIONS_SQL}
SELECT seq, brand_name, lower(trim(brand_name)) IN (SELECT lower(brand_name) FROM mentions) AS has_mentions
FROM candidates""",
    "append_with_ids": f"""WITH {st.RESPONSES_SQL}
SELECT (SELECT max(id) FROM responses WHERE platform <> 'P') + row_number() OVER (ORDER BY id) AS id,
       prompt_id, platform, raw_text FROM responses WHERE platform = 'P'""",
    "add_prompts": f"""{ADD_PROMPTS_SQL}
SELECT id, text, stage FROM held
UNION ALL SELECT (SELECT max(id) FROM held) + row_number() OVER (ORDER BY seq), trim(text), lower(trim(stage)) FROM fresh""",
    "add_prompts_rejected": f"""{ADD_PROMPTS_SQL}
SELECT seq, trim(text) AS text, lower(trim(stage)) AS stage, coalesce(bad, 'duplicate') AS reason
FROM checked WHERE seq NOT IN (SELECT seq FROM fresh)""",
    "update_prompts": f"""{UPDATE_PROMPTS_SQL}
SELECT e.id, coalesce(trim(s.text), e.text) AS text, coalesce(lower(trim(s.stage)), e.stage) AS stage
FROM existing e LEFT JOIN standing s ON s.id = e.id""",
    "update_prompts_rejected": f"""{UPDATE_PROMPTS_SQL}
SELECT seq, id, trim(text) AS text, lower(trim(stage)) AS stage, why AS reason FROM judged WHERE why IS NOT NULL""",
    "delete_prompts": f"""WITH {BELOW_SQL}
SELECT c_custkey AS id, c_name AS text, {st.sql_choose('c_mktsegment', st.SEGMENT_STAGES)} AS stage
FROM customer WHERE c_custkey NOT IN (SELECT prompt_id FROM below)""",
    "delete_prompts_not_found": f"""WITH {BELOW_SQL}
SELECT prompt_id AS id, 'not_found' AS reason FROM below""",
    "delete_all_prompts": """SELECT 'prompts' AS table_name, count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM customer""",
    "delete_all_brands": f"""WITH {BRANDS_SQL}
SELECT 'brands' AS table_name, count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM brands""",
    "add_brands": f"""WITH {BRANDS_SQL}, {BRAND_CANDIDATES_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(brand_name)) ORDER BY seq) AS rn FROM candidates
           WHERE trim(brand_name) <> '')
SELECT ord, brand_name FROM brands
UNION ALL SELECT CAST((SELECT max(ord) FROM brands) + row_number() OVER (ORDER BY seq) AS INT), trim(brand_name)
FROM ranked WHERE rn = 1 AND lower(trim(brand_name)) NOT IN (SELECT lower(brand_name) FROM brands)""",
    "add_brands_rejected": f"""WITH {BRANDS_SQL}, {BRAND_CANDIDATES_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(brand_name)) ORDER BY seq) AS rn FROM candidates)
SELECT seq, trim(brand_name) AS brand_name,
       CASE WHEN trim(brand_name) = '' THEN 'empty_name' ELSE 'duplicate' END AS reason FROM ranked
WHERE rn > 1 OR trim(brand_name) = '' OR lower(trim(brand_name)) IN (SELECT lower(brand_name) FROM brands)""",
    "rename_brands": f"""{RENAME_SQL}
SELECT ord, brand_name FROM named""",
    "rename_brands_rejected": f"""{RENAME_SQL}
SELECT seq, old_name, trim(new_name) AS new_name, why AS reason FROM judged WHERE why IS NOT NULL""",
    "delete_brands": f"""{RENAME_SQL}
SELECT ord, brand_name FROM brands WHERE lower(brand_name) NOT IN (SELECT k FROM checked)""",
    "delete_brands_not_found": f"""{RENAME_SQL}
SELECT DISTINCT k AS brand_name, 'not_found' AS reason FROM checked
WHERE k NOT IN (SELECT lower(brand_name) FROM brands)""",
}
