"""Landed answers: raw answer documents and parsed landing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.functions.text import blank
from answerlens.lexicon import DAILY_MARKERS, RATE_LIMIT_MARKERS
from answerlens.schemas import ANSWER_JSON, LANDING


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDING).json(path)


def answer_text(answer: Column) -> Column:
    """All text parts of all candidates, joined; empty if there are none."""
    parts = F.transform(
        answer.candidates, lambda c: F.coalesce(c.content.parts.text, F.array().cast("array<string>"))
    )
    return F.coalesce(F.array_join(F.flatten(parts), ""), F.lit(""))


def answer_sources(answer: Column) -> Column:
    """``url, title`` of the sources the first candidate consulted, where either is given."""
    chunks = F.get(answer.candidates, F.lit(0)).grounding_metadata.grounding_chunks
    webs = F.coalesce(chunks.web, F.array().cast("array<struct<uri:string,title:string>>"))
    named = F.filter(webs, lambda w: ~blank(w.uri) | ~blank(w.title))
    return F.transform(named, lambda w: F.struct(w.uri.alias("url"), w.title.alias("title")))


def parse_documents(documents: DataFrame, answer_col: str = "answer", grounding: bool = True) -> DataFrame:
    """Replace the raw JSON answer by ``raw_text``, ``citations`` and ``grounded``."""
    parsed = documents.withColumn("_answer", F.from_json(answer_col, ANSWER_JSON))
    kept = [c for c in documents.columns if c != answer_col]
    answer = F.col("_answer")
    sources = answer_sources(answer)
    return parsed.select(
        *kept,
        answer_text(answer).alias("raw_text"),
        (sources if grounding else F.slice(sources, 1, 0)).alias("citations"),
        F.lit(grounding).alias("grounded"),
    )


def daily_quota_exhausted(error: Column) -> Column:
    """Whether a failure means that the quota of the whole day is used up."""

    def any_of(markers: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for marker in markers:
            found = found | F.contains(error, F.lit(marker))
        return found

    return F.coalesce(any_of(RATE_LIMIT_MARKERS) & any_of(DAILY_MARKERS), F.lit(False))


def usable() -> Column:
    """True for a landing row that has text and no error."""
    return blank(F.col("error")) & ~blank(F.col("raw_text"))
