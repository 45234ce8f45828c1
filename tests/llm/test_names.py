"""Columns of a table that are named like those the operators work with."""

import pytest
from pyspark.sql import functions as F

from answerlens.llm import decontamination, html_text, line_dedup, simhash, toxicity
from tests.llm.conftest import SF

NAMES = (
    "n_words", "spans", "items", "longest", "n_hit", "score", "_toxicity", "_kept_key", "component", "fp", "_winners", "_host", "_of",
    "winners", "main_text", "_units", "_own", "_text", "_doc", "row", "r", "starts", "doc", "own", "hash", "n", "path", "_cut", "_match_id",
)


@pytest.fixture(scope="module")
def clashing(table):
    return table.select("*", *(F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in NAMES))


def intact(found, replaced=()):
    for r in found.collect():
        assert all(r[n] == f"{n} of {r['doc_id']}" for n in NAMES if n not in replaced)


def test_stages_keep_columns_of_any_name(spark, clashing, table):
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    stages = {
        "toxicity": lambda d: toxicity.without_toxic(d, labels),
        "lines": line_dedup.without_repeated_lines,
        "copies": simhash.keep_one,
        "benchmark": lambda d: decontamination.decontaminate(d, bench),
    }
    for name, stage in stages.items():
        found = stage(clashing)
        assert found.columns == clashing.columns, name
        intact(found)
        assert sorted(found.select("doc_id", "text").collect()) == sorted(stage(table).select("doc_id", "text").collect()), name


def test_scores_and_texts_replace_their_own_column_only(spark, clashing):
    scored = toxicity.with_scores(clashing, toxicity.train(clashing, spark.read.parquet(f"{SF}/labels.parquet")))
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    intact(scored, ("score",))
    pages = clashing.withColumns({"url": F.lit("http://a.org/"), "html": F.concat(F.lit("<body><article><p>"), "doc_id", F.lit("</article>"))})
    texts = html_text.extract(pages)
    assert all(r["main_text"] == str(r["doc_id"]) for r in texts.collect())
    intact(texts, ("main_text",))
    lines = line_dedup.dedup_lines(clashing)
    intact(lines)
