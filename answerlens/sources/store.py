"""Fact tables on shared storage."""

from __future__ import annotations

import re
from collections.abc import Iterable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlens.operators.facts import Facts
from answerlens.operators.ids import with_unique_ids
from answerlens.schemas import CITATION_ITEMS, CITATIONS, MENTION_ITEMS, MENTIONS, RESPONSES, RUNS, empty

TABLES = {"responses": RESPONSES, "mentions": MENTIONS, "citations": CITATIONS}

SAFE_RUN_ID = re.compile(r"[A-Za-z0-9._-]+")

# What the responses table keeps besides its own columns, so that the other two tables come from it without a second
# pass over the texts.
PARSED = {"mention_items": MENTION_ITEMS, "citation_items": CITATION_ITEMS, "from_grounding": "boolean"}

# The folders of a table, one within the other.
PARTS = ("attempt", "run_id")


class FactStore:
    """Responses, mentions and citations as Parquet, and a table of the committed runs.

    Every attempt to write a run has folders of its own, and nothing is ever overwritten. An attempt counts from the
    moment its one row in ``runs`` is there: readers join the facts to the runs that stand, so a run that breaks half-way
    is invisible, in all tables alike, and is simply repeated. The newest commit of a run replaces the earlier ones;
    a commit that refreshes replaces all runs. Tables that do not exist yet read as empty ones.

    The rows of ``runs`` also hold the highest ids and the counts, so neither ids nor statistics need a scan of facts.
    Folders of replaced and broken attempts stay; removing them is left to whoever owns the storage.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path(table)).select(*schema.names)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return empty(self.spark, schema)
            raise

    @property
    def runs(self) -> DataFrame:
        """All commits, also those that no longer stand."""
        return self._read("runs", RUNS)

    def standing(self) -> DataFrame:
        """The commits whose facts count: of each run the newest one, if no later commit has cleared the store."""
        runs = self.runs
        cleared = runs.filter("refresh").agg(F.coalesce(F.max("number"), F.lit(0))).scalar()
        newest = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("number"), F.desc("attempt")))
        return runs.withColumn("_turn", newest).filter((F.col("_turn") == 1) & (F.col("number") >= cleared)).drop("_turn")

    def facts_of(self, table: str, runs: DataFrame, extra: Iterable[T.StructField] = ()) -> DataFrame:
        """Rows of a table that belong to the given commits, with ``attempt`` and ``run_id``."""
        schema = T.StructType(TABLES[table].fields + list(extra) + [T.StructField(p, T.StringType()) for p in PARTS])
        # Spark prunes the folders by the few rows of the runs.
        return self._read(table, schema).join(runs.select(*PARTS), list(PARTS), "left_semi").select(*schema.names)

    def table(self, name: str) -> DataFrame:
        return self.facts_of(name, self.standing()).select(*TABLES[name].names)

    @property
    def responses(self) -> DataFrame:
        return self.table("responses")

    @property
    def mentions(self) -> DataFrame:
        return self.table("mentions")

    @property
    def citations(self) -> DataFrame:
        return self.table("citations")

    def facts(self) -> Facts:
        return Facts(self.responses, self.mentions, self.citations)

    def before_run(self, table: str, run_id: str) -> DataFrame:
        """Rows of all other runs."""
        return self.facts_of(table, self.standing().filter(F.col("run_id") != run_id)).select(*TABLES[table].names)

    def next_ids(self) -> tuple[dict[str, int], int]:
        """One more than the highest id ever given in each table, and the number of the next commit; reads no facts."""
        highest = [F.coalesce(F.max(f"last_{name}"), F.lit(0)).alias(name) for name in TABLES]
        row = self.runs.agg(*highest, F.coalesce(F.max("number"), F.lit(0)).alias("number")).first()
        return {name: row[name] + 1 for name in TABLES}, row["number"] + 1

    def _write(self, table: str, rows: DataFrame, attempt: str, run_id: str | None, **counts) -> dict[str, int]:
        """Write rows of one run (or of the runs in their column ``run_id``); counts and the highest id are taken on the way."""
        seen = Observation()
        counts = {"rows": F.count(F.lit(1)), "last": F.max("id"), **counts}
        observed = rows.observe(seen, *(value.alias(name) for name, value in counts.items()))
        folder = f"{self.path(table)}/attempt={attempt}"
        if run_id is None:
            observed.write.partitionBy("run_id").parquet(folder)
        else:
            observed.write.parquet(f"{folder}/run_id={run_id}")
        return seen.get

    def _commit(self, rows: list[dict]) -> None:
        """Make attempts count: one file, so that readers see all of it or nothing."""
        data = [tuple(row.get(name) for name in RUNS.names) for row in rows]
        attempt = rows[0]["attempt"]
        self.spark.createDataFrame(data, RUNS).coalesce(1).write.parquet(f"{self.path('runs')}/commit={attempt}")

    def write_run(self, parsed: DataFrame, run_id: str, refresh: bool = False, landed: Observation | None = None) -> dict:
        """Write the parsed answers of a run to all three tables and commit; ``refresh`` replaces all other runs as well.

        Whatever the run held before is replaced in all three, also where it now has no rows. Two runs must not be written
        at the same time: ids go on from the highest. ``landed`` is what ``parsed`` observes of the landing rows
        (``landed``, ``skipped``). Returns the committed row.

        Ids are given when the responses are written. Mentions and citations are read back from there, so a recomputed
        task cannot give an answer another id.
        """
        if not SAFE_RUN_ID.fullmatch(run_id):
            raise ValueError(f"a run id has letters, digits and . _ - only: {run_id!r}")
        starts, number = self.next_ids()
        attempt = uuid4().hex

        def total(value):
            return F.coalesce(F.sum(value), F.lit(0)).cast("long")

        cited = F.size("citation_items")
        # One stamp for all answers of a run.
        stamped = with_unique_ids(parsed, starts["responses"]).withColumn("timestamp", F.current_timestamp())
        seen = self._write(
            "responses",
            stamped.select(*RESPONSES.names, *PARSED),
            attempt,
            run_id,
            total_mentions=total(F.size("mention_items")),
            total_citations=total(cited),
            grounded_citations=total(F.when(F.col("from_grounding"), cited)),
        )
        commit = {"attempt": attempt, "run_id": run_id, "number": number, "refresh": refresh, "processed": seen["rows"]}
        commit |= {name: seen[name] for name in ("total_mentions", "total_citations", "grounded_citations")}
        commit["fallback_citations"] = seen["total_citations"] - seen["grounded_citations"]
        commit["last_responses"] = seen["last"] or starts["responses"] - 1
        commit |= {"total_prompts": seen["rows"], "skipped": 0}
        if landed is not None:
            commit |= {"total_prompts": landed.get["landed"], "skipped": landed.get["skipped"]}
        schema = T.StructType([f for f in RESPONSES.fields if f.name == "id"])
        for name in ("mention_items", "citation_items"):
            schema = schema.add(name, T.DataType.fromDDL(PARSED[name]))
        written = self.spark.read.schema(schema).parquet(f"{self.path('responses')}/attempt={attempt}/run_id={run_id}")
        for table, items in (("mentions", "mention_items"), ("citations", "citation_items")):
            rows = written.select(F.col("id").alias("response_id"), F.explode(items).alias("item"))
            numbered = with_unique_ids(rows.select("response_id", "item.*"), starts[table])
            seen = self._write(table, numbered.select(*TABLES[table].names), attempt, run_id)
            commit[f"last_{table}"] = seen["last"] or starts[table] - 1
        self._commit([commit])
        return commit

    def delete_responses(self, keys: DataFrame) -> list[str]:
        """Delete the answers of ``keys`` (prompt_id, platform) with their mentions and citations; returns the runs rewritten.

        Only runs that hold such answers are written anew, in one job a table, and committed together; the folders of all
        others are left as they are.
        """
        standing = self.standing()
        doomed = self.facts_of("responses", standing).join(keys.select("prompt_id", "platform").distinct(), ["prompt_id", "platform"], "left_semi")
        # At most one row a run.
        names = [row.run_id for row in doomed.select("run_id").distinct().collect()]
        if not names:
            return []
        touched = standing.filter(F.col("run_id").isin(names))
        attempt, number = uuid4().hex, self.next_ids()[1]
        kept_items = [T.StructField(n, T.DataType.fromDDL(k)) for n, k in PARSED.items()]
        for table, extra in (("responses", kept_items), ("mentions", ()), ("citations", ())):
            key = "id" if table == "responses" else "response_id"
            rows = self.facts_of(table, touched, extra)
            kept = rows.join(doomed.select(F.col("id").alias(key)), key, "left_anti")
            self._write(table, kept.select(*TABLES[table].names, *(f.name for f in extra), "run_id"), attempt, None)
        rows = [row.asDict() | {"attempt": attempt, "number": number, "refresh": False} for row in touched.collect()]
        self._commit(rows)
        return sorted(names)

    def write_snapshot(self, facts: Facts, run_id: str = "snapshot") -> None:
        """Write whole tables, such as the outcome of a delete, as the only content of this store."""
        starts, number = self.next_ids()
        commit = {"attempt": uuid4().hex, "run_id": run_id, "number": number, "refresh": True}
        for name, schema in TABLES.items():
            seen = self._write(name, getattr(facts, name).select(*schema.names), commit["attempt"], run_id)
            commit[f"last_{name}"] = max(seen["last"] or 0, starts[name] - 1)
        self._commit([commit])

    def clear(self) -> None:
        """Remove all facts: a commit of an empty run that refreshes."""
        self.write_snapshot(Facts(*(empty(self.spark, schema) for schema in TABLES.values())))


def create_tables(spark: SparkSession, database: str, buckets: int) -> None:
    """Catalog tables for the facts, if absent, bucketed on the response.

    Reports join mentions and citations to responses; tables bucketed alike join without a shuffle.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in TABLES.items():
        key = "id" if name == "responses" else "response_id"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS"
        )


def publish(facts: Facts, database: str) -> None:
    """Replace the content of the catalog tables."""
    for name, schema in TABLES.items():
        getattr(facts, name).select(*schema.names).write.insertInto(f"{database}.{name}", overwrite=True)
