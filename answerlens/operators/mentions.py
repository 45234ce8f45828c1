"""Brand mentions: which brands an answer names, in what order, and how it speaks of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.functions import text as tx
from answerlens.lexicon import NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS

# Every brand costs a scan of every text. Above this many, ``operators.dictionary`` is faster, with the same rows.
LITERAL_BRANDS = 256


HITS = "array<struct<first_index:int,ord:int,brand_name:string,width:int,stretch:string>>"


def with_hits(answers: DataFrame, brands: Sequence[str], text_col: str = "raw_text") -> DataFrame:
    """Add ``hits``: one struct per brand found, in order of first appearance, ties in list order.

    A narrow step: no join and no shuffle, however skewed the answers are over prompts or sources.
    Each struct holds the stretch of text around the match, so nothing later needs the full text.
    """
    names = [name for name in brands if name]
    none = F.array().cast(HITS)
    if not names:
        return answers.withColumn("hits", none)
    keys = [name.lower() for name in names]
    patterns = F.lit([tx.up_to_whole_word(key) for key in keys])
    lowered = answers.withColumn("_lowered", F.lower(text_col))

    def located(key: Column, order: Column) -> Column:
        # The plain substring test is far cheaper than the regex and settles most rows.
        end = F.length(tx.extract(F.col("_lowered"), F.get(patterns, order)))
        return F.when(F.contains("_lowered", key), F.struct((end - F.length(key)).alias("first_index"), order.alias("ord")))

    present = F.array_compact(F.transform(F.lit(keys), located))
    found = F.filter(present, lambda entry: entry.first_index >= 0)

    def hit(entry: Column) -> Column:
        width = F.get(F.lit([len(name) for name in names]), entry.ord)
        return F.struct(
            entry.first_index.alias("first_index"),
            entry.ord.alias("ord"),
            F.get(F.lit(names), entry.ord).alias("brand_name"),
            width.alias("width"),
            tx.surroundings(F.col(text_col), entry.first_index, width).alias("stretch"),
        )

    hits = F.transform(F.sort_array(found), hit)
    return lowered.select(*answers.columns, hits.cast(HITS).alias("hits"))


def mention_items(
    hits: Column,
    positive: Sequence[str] = POSITIVE_KEYWORDS,
    negative: Sequence[str] = NEGATIVE_KEYWORDS,
    word_match: bool = False,
) -> Column:
    """``hits`` as mentions: the rank in the answer and the sentiment of the surrounding sentence."""

    def mention(hit: Column, at: Column) -> Column:
        sentence = tx.context(hit.stretch, hit.first_index, hit.width)
        return F.struct(
            hit.brand_name.alias("brand_name"),
            (at + 1).cast("int").alias("position"),
            tx.sentiment(sentence, positive, negative, word_match).alias("sentiment"),
        )

    return F.transform(hits, mention)


def located_brands(answers: DataFrame, brands: Sequence[str], id_col: str = "id", text_col: str = "raw_text") -> DataFrame:
    """One row per answer and brand found, with index, rank and context."""
    hits = with_hits(answers.select(id_col, text_col), brands, text_col)
    # The outer form, because the optimizer adds a "has items" filter to the plain one and pushes a
    # second copy of the whole search below it.
    rows = hits.select(F.col(id_col).alias("response_id"), F.posexplode_outer("hits").alias("at", "hit"))
    return rows.filter(F.col("hit").isNotNull()).select(
        "response_id",
        F.col("hit.ord").alias("ord"),
        F.col("hit.brand_name").alias("brand_name"),
        F.col("hit.first_index").alias("first_index"),
        (F.col("at") + 1).alias("position"),
        tx.context(F.col("hit.stretch"), F.col("hit.first_index"), F.col("hit.width")).alias("context"),
    )


def extract_mentions(
    answers: DataFrame,
    brands: Sequence[str],
    positive: Sequence[str] = POSITIVE_KEYWORDS,
    negative: Sequence[str] = NEGATIVE_KEYWORDS,
    word_match: bool = False,
    id_col: str = "id",
    text_col: str = "raw_text",
) -> DataFrame:
    """Mentions of all answers: ``response_id, brand_name, position, sentiment``."""
    found = located_brands(answers, brands, id_col, text_col)
    return found.select(
        "response_id",
        "brand_name",
        "position",
        tx.sentiment(F.col("context"), positive, negative, word_match).alias("sentiment"),
    )
