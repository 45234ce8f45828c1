"""Typed schemas and enumerations of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The funnel stages and sentiment labels results are compared on.
STAGES = ("research", "comparison", "recommendation", "problem_solving", "vendor_selection")
SENTIMENTS = ("recommended", "neutral", "negative")
UNKNOWN_STAGE = "unknown"

RESPONSES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("prompt_id", T.LongType(), False),
        T.StructField("platform", T.StringType(), False),
        T.StructField("raw_text", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
    ]
)

MENTIONS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("response_id", T.LongType(), False),
        T.StructField("brand_name", T.StringType(), False),
        T.StructField("position", T.IntegerType(), False),
        T.StructField("sentiment", T.StringType(), False),
    ]
)

CITATIONS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("response_id", T.LongType(), False),
        T.StructField("source_url", T.StringType(), True),
        T.StructField("source_domain", T.StringType(), False),
    ]
)

PROMPTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("stage", T.StringType()),
    ]
)

BRANDS = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("brand_name", T.StringType()),
    ]
)

# One source a grounded answer consulted.
SOURCE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
    ]
)

# One answer as it was landed, before parsing.
LANDING = T.StructType(
    [
        T.StructField("prompt_id", T.LongType()),
        T.StructField("platform", T.StringType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("citations", T.ArrayType(SOURCE)),
        T.StructField("grounded", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

# Per-answer results of parsing; exploded into MENTIONS and CITATIONS.
MENTION_ITEMS = "array<struct<brand_name:string,position:int,sentiment:string>>"
CITATION_ITEMS = "array<struct<source_url:string,source_domain:string>>"

# One commit of the fact store: what it replaces, the highest ids and the statistics of the run.
RUNS = T.StructType(
    [
        T.StructField("attempt", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("number", T.LongType()),
        T.StructField("refresh", T.BooleanType()),
        *(T.StructField(f"last_{table}", T.LongType()) for table in ("responses", "mentions", "citations")),
        *(
            T.StructField(name, T.LongType())
            for name in (
                "total_prompts", "processed", "skipped", "total_mentions", "total_citations", "grounded_citations",
                "fallback_citations",
            )
        ),
    ]
)

# The raw answer document of the model service.
ANSWER_JSON = T.StructType(
    [
        T.StructField(
            "candidates",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "content",
                            T.StructType(
                                [
                                    T.StructField(
                                        "parts",
                                        T.ArrayType(T.StructType([T.StructField("text", T.StringType())])),
                                    )
                                ]
                            ),
                        ),
                        T.StructField(
                            "grounding_metadata",
                            T.StructType(
                                [
                                    T.StructField(
                                        "grounding_chunks",
                                        T.ArrayType(
                                            T.StructType(
                                                [
                                                    T.StructField(
                                                        "web",
                                                        T.StructType(
                                                            [
                                                                T.StructField("uri", T.StringType()),
                                                                T.StructField("title", T.StringType()),
                                                            ]
                                                        ),
                                                    )
                                                ]
                                            )
                                        ),
                                    )
                                ]
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
