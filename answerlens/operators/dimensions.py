"""Batch maintenance of the prompt and brand dimensions.

Every batch row carries a unique ``seq``. The outcome is that of applying the rows one after the other:

* Of rows that add the same text or name, the first one counts.
* Updates and renames see the dimension as the rows before them have left it (``operators.claims``), so a prompt
  may be updated many times, and a text or name that a row frees may be taken by a later one.
* Winners are found by aggregates that combine before the shuffle and fetched back by ``seq`` or id, so
  any number of equal texts or names in a batch lands in no single task.
* Facts are never touched: renaming or deleting a dimension row does not rewrite history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.functions.text import blank, folded, strip
from answerlens.operators.claims import settle_claims, settle_renames
from answerlens.operators.ids import next_id, with_sequential_ids
from answerlens.schemas import STAGES


@dataclass(frozen=True)
class Change:
    """The new state of a dimension and the batch rows that were turned down, with the reason."""

    result: DataFrame
    rejected: DataFrame


def _checked_prompts(batch: DataFrame) -> DataFrame:
    cleaned = batch.withColumns(
        {"text": strip(F.col("text")), "stage": F.lower(strip(F.col("stage"))), "_key": folded(F.col("text"))}
    )
    known_stage = F.coalesce(F.col("stage"), F.lit("")).isin(*STAGES)
    return cleaned.withColumn(
        "reason", F.when(blank(F.col("text")), "empty_text").when(~known_stage, "invalid_stage")
    )


def _new_seqs(valid: DataFrame, held: DataFrame) -> DataFrame:
    """``seq`` of the first batch row of each key that is not held yet."""
    firsts = valid.groupBy("_key").agg(F.min("seq").alias("seq"))
    return firsts.join(held.distinct(), "_key", "left_anti").select("seq")


def _split(checked: DataFrame, accepted_seqs: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    accepted = checked.join(accepted_seqs, "seq", "left_semi")
    rejected = checked.join(accepted_seqs, "seq", "left_anti").withColumn("reason", reason)
    return accepted, rejected


def add_prompts(existing: DataFrame, candidates: DataFrame) -> Change:
    """Append ``seq, text, stage`` rows whose text is new; ids go on from the highest existing one."""
    checked = _checked_prompts(candidates)
    held = existing.select(folded(F.col("text")).alias("_key"))
    fresh = _new_seqs(checked.filter("reason IS NULL"), held)
    accepted, rejected = _split(checked, fresh, F.coalesce("reason", F.lit("duplicate")))
    added = with_sequential_ids(accepted, "seq", next_id(existing))
    return Change(
        existing.unionByName(added.select("id", "text", "stage")), rejected.select("seq", "text", "stage", "reason")
    )


def add_brands(existing: DataFrame, candidates: DataFrame) -> Change:
    """Append ``seq, brand_name`` rows whose name is new, behind the existing ones."""
    checked = candidates.withColumns(
        {"brand_name": strip(F.col("brand_name")), "_key": folded(F.col("brand_name"))}
    ).withColumn("reason", F.when(blank(F.col("brand_name")), "empty_name"))
    held = existing.select(folded(F.col("brand_name")).alias("_key"))
    fresh = _new_seqs(checked.filter("reason IS NULL"), held)
    accepted, rejected = _split(checked, fresh, F.coalesce("reason", F.lit("duplicate")))
    start = existing.agg(F.coalesce(F.max("ord"), F.lit(-1)) + 1).scalar()
    added = with_sequential_ids(accepted, "seq", start, "ord")
    return Change(
        existing.unionByName(added.select(F.col("ord").cast("int"), "brand_name")),
        rejected.select("seq", "brand_name", "reason"),
    )


def _judged(checked: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a batch of which the valid ones have been settled."""
    placed = checked.join(outcomes, "seq", "left")
    rejected = placed.filter("outcome IS NULL OR outcome <> 'accepted'").withColumn("reason", F.coalesce("reason", "outcome"))
    return placed.filter("outcome = 'accepted'"), rejected


def update_prompts(existing: DataFrame, updates: DataFrame) -> Change:
    """Apply ``seq, id, text, stage`` rows one after the other; texts stay unique, whatever their case.

    Rejected: ``empty_text``, ``invalid_stage``, ``duplicate`` (another prompt has the text when the row's turn comes),
    ``not_found``, in this order.
    """
    checked = _checked_prompts(updates)
    owners = existing.select(F.col("id").alias("target"), folded(F.col("text")).alias("key"))
    claims = checked.filter("reason IS NULL").select("seq", F.col("id").alias("target"), F.col("_key").alias("key"))
    accepted, rejected = _judged(checked, settle_claims(owners, claims))
    new = accepted.groupBy("id").agg(F.max_by(F.struct("text", "stage"), "seq").alias("_new"))
    result = existing.join(new, "id", "left").select(
        "id", F.coalesce("_new.text", "text").alias("text"), F.coalesce("_new.stage", "stage").alias("stage")
    )
    return Change(result, rejected.select("seq", "id", "text", "stage", "reason"))


def rename_brands(existing: DataFrame, renames: DataFrame) -> Change:
    """Apply ``seq, old_name, new_name`` rows one after the other to all entries of the old name, in place.

    Changing only the case is allowed, taking another brand's name is not. Rejected: ``empty_name``, ``not_found`` (no
    brand has the old name when the row's turn comes), ``duplicate``, in this order.
    """
    checked = renames.withColumns(
        {
            "new_name": strip(F.col("new_name")),
            "_new": folded(F.col("new_name")),
            "_old": F.coalesce(folded(F.col("old_name")), F.lit("")),
        }
    ).withColumn("reason", F.when(blank(F.col("new_name")), "empty_name"))
    key = folded(F.col("brand_name"))
    moves = checked.filter("reason IS NULL").select("seq", F.col("_old").alias("old"), F.col("_new").alias("new"), F.col("new_name").alias("label"))
    outcomes, labels = settle_renames(existing.select(key.alias("name")), moves)
    _, rejected = _judged(checked, outcomes)
    result = existing.join(labels, key == F.col("name"), "left").select(
        "ord", F.coalesce("label", "brand_name").alias("brand_name")
    )
    return Change(result, rejected.select("seq", "old_name", "new_name", "reason"))


def delete_prompts(existing: DataFrame, ids: DataFrame) -> Change:
    keys = ids.select("id").distinct()
    rejected = keys.join(existing, "id", "left_anti").withColumn("reason", F.lit("not_found"))
    return Change(existing.join(keys, "id", "left_anti").select(*existing.columns), rejected)


def delete_brands(existing: DataFrame, names: DataFrame) -> Change:
    """Delete by name, whatever its case."""
    keys = names.select(F.coalesce(folded(F.col("brand_name")), F.lit("")).alias("_key")).distinct()
    keyed = existing.withColumn("_key", folded(F.col("brand_name")))
    rejected = keys.join(keyed, "_key", "left_anti").select(
        F.col("_key").alias("brand_name"), F.lit("not_found").alias("reason")
    )
    return Change(keyed.join(keys, "_key", "left_anti").select(*existing.columns), rejected)


def delete_all(existing: DataFrame) -> DataFrame:
    return existing.filter(F.lit(False))


def prompts_with_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Prompts with ``has_responses``."""
    used = responses.select(F.col("prompt_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    return prompts.join(used, "id", "left").select(
        *prompts.columns, F.coalesce("_used", F.lit(False)).alias("has_responses")
    )


def brands_with_mentions(brands: DataFrame, mentions: DataFrame) -> DataFrame:
    """Brands with ``has_mentions``, compared without regard to case."""
    used = mentions.select(F.lower("brand_name").alias("_key")).distinct().withColumn("_used", F.lit(True))
    keyed = brands.withColumn("_key", folded(F.col("brand_name")))
    return keyed.join(used, "_key", "left").select(
        *brands.columns, F.coalesce("_used", F.lit(False)).alias("has_mentions")
    )
