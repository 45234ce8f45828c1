"""Brand search for long brand lists.

One column per brand does not scale to thousands of brands. Here the word sequences of an answer are looked up among
the word sequences of the brands instead:

1. A name that begins and ends with a word character stands in a text exactly where its words do, with the same characters
   between them. Such sequences are looked up as they stand, with their first places, so no text is searched for a name.
   What a word is, Spark says; a small helper in Python cuts the sequences, as interpreted lambdas are ten times slower.
2. Any other name is checked by regex wherever its words, in sequence, are among the word sequences of the text.
3. A list of up to ``MOST_IN_PLAN`` names becomes a constant of the plan, dealt into buckets by hash. An answer looks its
   sequences up within its own row, so no text is shuffled or written, whether it has a candidate or not.
4. A longer list stays a table, which the sequences of the answers are joined to, without their texts. The candidates
   of an answer, far fewer than its words, are brought back to the text by its id.

A brand without a word stands between two words wherever it counts, so it is a whole run of other characters; those runs are
looked up likewise, if there is such a brand.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.functions import text as tx
from answerlens.operators.mentions import HITS

# Stands between the words of a sequence; no word contains it.
JOINT = " "

# The most names that are taken into the plan. About 200 bytes each, which every task gets once.
MOST_IN_PLAN = 100_000
BUCKETS = 1 << 14

_ENTRY = "struct<sequence:string,ord:int,brand_name:string,key:string,pattern:string>"
_HIT = ["first_index", "ord", "brand_name", "width", "stretch"]


def words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(f"{tx.WORD}+"), 0)


def gaps(lowered: Column) -> Column:
    """The runs of characters that belong to no word."""
    return F.regexp_extract_all(lowered, F.lit(rf"[^{tx.WORD[1:-1]}]+"), 0)


def _sequences(tokens: Column, length: int) -> Column:
    """All runs of ``length`` words, joined."""
    if length == 1:
        return tokens
    starts = F.when(F.size(tokens) >= length, F.sequence(F.lit(0), F.size(tokens) - length)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda at: F.concat_ws(JOINT, *[F.get(tokens, at + step) for step in range(length)]))


def first_places(lowered: str, marked: str, lengths: Sequence[int], known: set[tuple] | None = None) -> dict[str, int]:
    """The runs of that many words, with what stands between them, and where each stands first.

    ``marked`` is the same text with a blank for every character that belongs to no word. ``known``: only runs of these words.
    """
    words, starts, at, found = [], [], 0, {}
    for part in marked.split(" "):
        if part:
            words.append(part)
            starts.append(at)
        at += len(part) + 1
    for n in lengths:
        runs = enumerate(zip(*(words[k:] for k in range(n)), strict=False))
        # Backwards, so that the first place is what stays.
        for i in reversed([i for i, run in runs if known is None or run in known]):
            found[lowered[starts[i] : starts[i + n - 1] + len(words[i + n - 1])]] = starts[i]
    return found


def _marked(lowered: Column) -> Column:
    return F.regexp_replace(lowered, rf"[^{tx.WORD[1:-1]}]", " ")


def _listed(counts: list[int], columns: list[pa.Array], names: list[str]) -> pa.Array:
    """Rows of structs, as many as ``counts`` says for each."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names))


def _placed_hits(spark: SparkSession, entries: list[dict], text: Column) -> Column:
    """``HITS`` of the names that begin and end with a word character, in any order."""
    table: dict[str, list[int]] = {}
    for number, entry in enumerate(entries):
        table.setdefault(entry["sequence"], []).append(number)
    lengths = sorted({entry["length"] for entry in entries})
    known = {tuple(entry["words"]) for entry in entries}
    sent = spark.sparkContext.broadcast((table, known, [e["ord"] for e in entries], [e["brand_name"] for e in entries]))
    reach = tx.SENTENCE_REACH

    @F.arrow_udf(HITS)
    def hits(raw: pa.Array, lowered: pa.Array, marked: pa.Array) -> pa.Array:
        named, known, orders, names = sent.value
        widths = [len(name) for name in names]
        counts, numbers, starts, stretches = [], [], [], []
        for full, low, words_of in zip(raw.to_pylist(), lowered.to_pylist(), marked.to_pylist(), strict=True):
            places = {} if low is None else first_places(low, words_of, lengths, known)
            found = [(number, places[run]) for run in places.keys() & named.keys() for number in named[run]]
            counts.append(len(found))
            numbers += [number for number, _ in found]
            starts += [at for _, at in found]
            stretches += [full[max(at - reach, 0) : at + widths[number] + reach] for number, at in found]
        which = pa.array(numbers, pa.int32())
        lists = (orders, pa.int32()), (names, pa.string()), (widths, pa.int32())
        order, name, width = (pa.array(values, kind).take(which) for values, kind in lists)
        return _listed(counts, [pa.array(starts, pa.int32()), order, name, width, pa.array(stretches, pa.string())], _HIT)

    valid = F.make_valid_utf8(text)
    return hits(valid, F.lower(valid), _marked(F.lower(valid)))


def _places(text: Column, lengths: list[int]) -> Column:
    """All distinct runs of that many words with their first places: (sequence, at)."""

    @F.arrow_udf("array<struct<sequence:string,at:int>>")
    def places(lowered: pa.Array, marked: pa.Array) -> pa.Array:
        counts, runs, starts = [], [], []
        for low, words_of in zip(lowered, marked, strict=True):
            found = first_places(low.as_py(), words_of.as_py(), lengths) if low.is_valid else {}
            counts.append(len(found))
            runs += found.keys()
            starts += found.values()
        return _listed(counts, [pa.array(runs, pa.string()), pa.array(starts, pa.int32())], ["sequence", "at"])

    lowered = F.lower(F.make_valid_utf8(text))
    return places(lowered, _marked(lowered))


def _boundary_pattern(key: Column) -> Column:
    """The whole-word pattern of ``functions.text`` for a column of names."""
    literal = F.regexp_replace(key, r"([\\.\[\]{}()*+?^$|&\-~#])", r"\\$1")
    opens = F.when(key.rlike(rf"\A{tx.WORD}"), F.lit("!")).otherwise("=")
    closes = F.when(key.rlike(rf"{tx.WORD}\z"), F.lit("!")).otherwise("=")
    return F.concat(
        literal, F.lit("(?<"), opens, F.lit(tx.WORD), literal, F.lit(")(?"), closes, F.lit(tx.WORD), F.lit(")")
    )


def dictionary(brands: DataFrame) -> DataFrame:
    """``ord, brand_name, key, pattern, placed, sequence, length, words`` of the brands; length 0 and the name itself without words.

    A ``placed`` name begins and ends with a word character: it is its own sequence and needs no pattern.
    """
    keyed = brands.select("ord", "brand_name", F.lower("brand_name").alias("key"))
    placed = F.col("key").rlike(rf"\A{tx.WORD}") & F.col("key").rlike(rf"{tx.WORD}\z")
    tokenized = keyed.withColumn("_words", words(F.col("key"))).withColumn("placed", placed)
    return tokenized.filter("brand_name <> ''").select(
        "ord",
        "brand_name",
        "key",
        F.when(~F.col("placed"), F.concat(F.lit(r"(?s)\A.*?"), _boundary_pattern(F.col("key")))).alias("pattern"),
        "placed",
        F.when((F.size("_words") > 0) & ~F.col("placed"), F.array_join("_words", JOINT)).otherwise(F.col("key")).alias("sequence"),
        F.size("_words").alias("length"),
        F.col("_words").alias("words"),
    )


def names_for_plan(brands: DataFrame, at_most: int = MOST_IN_PLAN) -> list[dict] | None:
    """The entries of the brands, or None if there are more than ``at_most``; never fetches more than that."""
    bucket = F.pmod(F.xxhash64("sequence"), F.lit(BUCKETS)).cast("int").alias("bucket")
    rows = dictionary(brands).select("*", bucket).limit(at_most + 1).collect()
    return [row.asDict() for row in rows] if len(rows) <= at_most else None


def _bucketed(entries: list[dict]) -> Column:
    """The entries as a constant array of buckets, by the hash of their sequence."""
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for entry in entries:
        buckets[entry["bucket"]].append({k: v for k, v in entry.items() if k not in ("bucket", "length", "placed", "words")})
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<{_ENTRY}>>")


def _hits(candidates: Column, lowered: Column, text: Column, with_places: bool = False) -> Column:
    """The candidates that the text names, as ``HITS``; those ``with_places`` are searched for only where ``at`` is null."""

    def located(entry: Column) -> Column:
        searched = F.length(tx.extract(lowered, entry.pattern))
        end = F.coalesce(entry["at"] + F.length(entry.key), searched) if with_places else searched
        return F.struct(
            (end - F.length(entry.key)).alias("first_index"), entry.ord.alias("ord"), entry.brand_name.alias("brand_name"), end.alias("end")
        )

    def hit(found: Column) -> Column:
        return F.struct(
            found.first_index.alias("first_index"),
            found.ord.alias("ord"),
            found.brand_name.alias("brand_name"),
            F.length(found.brand_name).alias("width"),
            tx.surroundings(text, found.first_index, F.length(found.brand_name)).alias("stretch"),
        )

    found = F.filter(F.transform(candidates, located), lambda f: f.end > 0)
    return F.sort_array(F.transform(found, hit))


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is worked out once a row, not once for every use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _distinct_sequences(lowered: Column, lengths: list[int]) -> Column:
    def runs(tokens: Column) -> Column:
        return F.concat(*(_sequences(tokens, n) if n else gaps(lowered) for n in lengths))

    return F.array_distinct(_bound(words(lowered), runs))


def with_dictionary_hits(
    answers: DataFrame, brands: DataFrame, id_col: str | None = None, text_col: str = "raw_text", most_in_plan: int = MOST_IN_PLAN
) -> DataFrame:
    """Same as ``operators.mentions.with_hits``, for a brand table of any size.

    Ids must be unique; they are needed for lists of more than ``most_in_plan`` names only.
    """
    entries = names_for_plan(brands, most_in_plan)
    if entries is None:
        return _hits_by_join(answers, brands, id_col, text_col)
    if not entries:
        return answers.withColumn("hits", F.array().cast(HITS))
    placed, searched = ([e for e in entries if e["placed"] == kind] for kind in (True, False))
    text, found = F.col(text_col), []
    if placed:
        found.append(_placed_hits(answers.sparkSession, placed, text))
    if searched:
        table, lengths = _bucketed(searched), sorted({entry["length"] for entry in searched})

        def candidates(lowered: Column) -> Column:
            def named(sequence: Column) -> Column:
                return F.filter(F.get(table, F.pmod(F.xxhash64(sequence), F.lit(BUCKETS)).cast("int")), lambda entry: entry.sequence == sequence)

            return F.flatten(F.transform(_distinct_sequences(lowered, lengths), named))

        found.append(_bound(F.lower(text), lambda lowered: _hits(candidates(lowered), lowered, text)))
    every = F.concat(*(F.coalesce(hits, F.array()).cast(HITS) for hits in found))
    return answers.select("*", F.sort_array(every).alias("hits"))


def _hits_by_join(answers: DataFrame, brands: DataFrame, id_col: str, text_col: str) -> DataFrame:
    entries = dictionary(brands)
    # Few distinct values: the word counts of brand names.
    kinds = entries.select("length", "placed").distinct().collect()
    placed, searched = (sorted(k.length for k in kinds if k.placed == kind) for kind in (True, False))

    # Two generators, as one of both kinds would hold them all in one array.
    key, none, spread = F.col(id_col).alias("_id"), F.lit(None).cast("int").alias("at"), []
    if placed:
        spread.append(answers.select(key, F.explode_outer(_places(F.col(text_col), placed)).alias("s")).select("_id", "s.sequence", "s.at", F.lit(True).alias("placed")))
    if searched:
        sequences = _distinct_sequences(F.lower(text_col), searched)
        spread.append(answers.select(key, F.explode_outer(sequences).alias("sequence")).select("_id", "sequence", none, F.lit(False).alias("placed")))
    if not spread:
        return answers.withColumn("hits", F.array().cast(HITS))
    candidate = F.struct("ord", "brand_name", "key", "pattern", "at")
    candidates = reduce(DataFrame.unionByName, spread).join(entries.drop("words"), ["sequence", "placed"]).groupBy("_id").agg(F.collect_list(candidate).alias("_candidates"))
    joined = answers.join(candidates, answers[id_col] == F.col("_id"), "left")
    # The text is lower-cased once per answer, not once per candidate.
    hits = _bound(F.lower(text_col), lambda lowered: _hits(F.col("_candidates"), lowered, F.col(text_col), with_places=True))
    return joined.select(*answers.columns, F.coalesce(hits, F.array()).cast(HITS).alias("hits"))
