"""The corpus pipeline: stages that each work on all that the stage before kept.

Toxic documents go, repeated passages are removed, one document of each group of near copies stays, contaminated
documents go and shorter matches are cut out, and what is left is packed. Every stage but the last returns the columns of
``documents``; its result is written to the shared folder and read again as the next one's input. Nulls, empty texts,
repeated rows and empty tables are treated as each operator's docstring says.

The stages learn, compare and match with more than SQL has, so there is no SQL for the whole; the tests hold each stage
against a brute-force version on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerlens.llm import common, decontamination, encoder, line_dedup, packing, simhash, toxicity


# Executors come to the packing with the heap that earlier stages have grown, so workers remember fewer words.
CACHE_WORDS = 150_000


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, scores below the threshold."""
    return toxicity.without_toxic(docs, common.tuned(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; one with nothing of its own left goes."""
    return line_dedup.without_repeated_lines(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items cover less than a twentieth, without the passages of the items."""
    return decontamination.decontaminate(docs, common.tuned(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 ids."""
    return packing.pack(docs, encoder.public_tokenizer(), cache_words=CACHE_WORDS)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the result of the last one."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
