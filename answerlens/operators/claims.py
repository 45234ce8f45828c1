"""Batches whose rows take effect one after the other, in order of ``seq``, settled in rounds.

Whether a row stands depends on who holds what when its turn comes, and so on rows before it. A round decides, for every
key at once, all rows whose outcome does not depend on an open row any more:

* while a key is surely held, what else claims it is turned down, however many rows that are;
* a key that is surely free goes to the first open row that claims it.

The earliest open row can always be decided, so the rounds end; there are as many as the longest series of hand-overs
that wait for each other, not as many as there are rows. Every join is with one row per key, found by aggregates that combine
before the shuffle, so a key that very many rows claim is split like any skewed join. Each round writes the rows that were
open. Up to ``FEW`` rows, whose rounds would be overhead only, are settled by a loop instead, to the same results.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.session import written

# Before and after all rows.
START, END = -(2**63), 2**63 - 1

# So many rows, dimension and batch together, are settled by a plain loop in one task, with the same results: rounds on
# small tables are all overhead. Beyond, nothing is ever gathered.
FEW = 500_000


def _from(seq: Column) -> Column:
    return F.coalesce(seq, F.lit(END))


def _union(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows


def _loop_renames(names: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same as ``settle_renames``, row by row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = {name: name for name in rows.loc[rows["seq"].isna(), "old"]}
        labels, out = {}, []
        for row in rows[rows["seq"].notna()].sort_values("seq").itertuples():
            if row.old not in held:
                outcome = "not_found"
            elif row.new != row.old and row.new in held:
                outcome = "duplicate"
            else:
                outcome, root = "accepted", held.pop(row.old)
                held[row.new], labels[root] = root, row.label
            out.append((row.seq, outcome, None, None))
        return pd.DataFrame(out + [(None, None, name, label) for name, label in labels.items()], columns=["seq", "outcome", "name", "label"])

    none = F.lit(None).cast("string")
    rows = names.select(F.lit(None).cast("long").alias("seq"), F.col("key").alias("old"), none.alias("new"), none.alias("label"))
    rows = rows.unionByName(moves.select("seq", "old", "new", "label"))
    # As a decimal, since a nullable long would reach pandas as a fraction.
    rows = rows.withColumn("seq", F.col("seq").cast("decimal(20,0)"))
    done = rows.groupBy().applyInPandas(run, "seq decimal(20,0), outcome string, name string, label string")
    done, _ = written(done.withColumn("seq", F.col("seq").cast("long")), "renamed")
    return done.filter("outcome IS NOT NULL").select("seq", "outcome"), done.filter("name IS NOT NULL").select("name", "label")


def _loop_claims(events: DataFrame) -> DataFrame:
    """The same as ``settle_claims``, row by row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows["seq"] == START
        texts = dict(zip(rows.loc[first, "target"], rows.loc[first, "key"], strict=True))
        holders = Counter(texts.values())
        out = []
        for row in rows[~first].sort_values("seq").itertuples():
            own = texts.get(row.target)
            if holders[row.key] - (own == row.key) > 0:
                outcome = "duplicate"
            elif row.target not in texts:
                outcome = "not_found"
            else:
                outcome, texts[row.target] = "accepted", row.key
                holders[own] -= 1
                holders[row.key] += 1
            out.append((row.seq, outcome))
        return pd.DataFrame(out, columns=["seq", "outcome"])

    done, _ = written(events.select("seq", "target", "key").groupBy().applyInPandas(run, "seq long, outcome string"), "claimed")
    return done


def settle_renames(names: DataFrame, moves: DataFrame, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Renames (seq, old, new, label) of the held names (name): what becomes of each row, and of each name.

    A rename stands if its old name is held when its turn comes and its new name is not, or is the old one. Returns
    (seq, outcome), the outcome being ``accepted``, ``not_found`` or ``duplicate``, and (name, label): the label that
    what was called ``name`` has in the end, null if it was not renamed.
    """
    state = names.select(F.col("name").alias("key"), F.col("name").alias("root"), F.lit(None).cast("string").alias("label")).distinct()
    state, held = written(state, "names", n=F.count(F.lit(1)))
    open_, asked = written(moves.select("seq", "old", "new", "label", F.lit(False).alias("doomed")), "renames", n=F.count(F.lit(1)))
    if held["n"] + asked["n"] <= few:
        return _loop_renames(state, open_)
    settled = []
    while True:
        moving = open_.filter("NOT doomed AND old <> new")
        leaves = moving.groupBy(F.col("old").alias("key")).agg(F.min("seq").alias("leave"))
        arrives = moving.groupBy(F.col("new").alias("key")).agg(F.min("seq").alias("arrive"))
        keys = state.join(leaves, "key", "full").join(arrives, "key", "full")
        # One row per name: who holds it, and the first open rows that would give it up or take it.
        old = keys.select(F.col("key").alias("old"), F.col("root").alias("o_root"), F.col("leave").alias("o_leave"), F.col("arrive").alias("o_arrive"))
        new = keys.select(F.col("key").alias("new"), F.col("root").alias("n_root"), F.col("leave").alias("n_leave"), F.col("arrive").alias("n_arrive"))
        placed = open_.join(old, "old", "left").join(new, "new", "left")
        found = F.col("o_root").isNotNull() & (F.col("seq") <= _from(F.col("o_leave")))
        missing = F.col("o_root").isNull() & (F.col("seq") < _from(F.col("o_arrive")))
        taken = (F.col("old") != F.col("new")) & F.col("n_root").isNotNull() & (F.col("seq") < _from(F.col("n_leave")))
        free = F.col("n_root").isNull() & (F.col("seq") == F.col("n_arrive")) & (F.col("seq") == F.col("o_leave"))
        outcome = (
            F.when(missing, "not_found")
            .when(found & (taken | F.col("doomed")), "duplicate")
            # Turned down, but whether for its old name as well is not known yet.
            .when(taken | F.col("doomed"), "doomed")
            .when(found & ((F.col("old") == F.col("new")) | free), "accepted")
        )
        judged, left = written(
            placed.select("seq", "old", "new", "label", F.col("o_root").alias("root"), outcome.alias("outcome")), "renames",
            open=F.count_if(F.col("outcome").isNull() | (F.col("outcome") == "doomed")),
        )
        settled.append(judged.filter("outcome <> 'doomed'").select("seq", "outcome"))
        accepted = judged.filter("outcome = 'accepted'")
        changes = accepted.select(F.col("new").alias("key"), F.struct("seq", "root", "label").alias("last")).unionByName(
            accepted.filter("old <> new").select(
                F.col("old").alias("key"), F.struct("seq", F.lit(None).cast("string").alias("root"), F.lit(None).cast("string").alias("label")).alias("last")
            )
        )
        changed = changes.groupBy("key").agg(F.max_by("last", "last.seq").alias("last")).select("key", "last.root", "last.label")
        state, _ = written(state.join(changed, "key", "left_anti").unionByName(changed), "names")
        open_ = judged.filter("outcome IS NULL OR outcome = 'doomed'").select(
            "seq", "old", "new", "label", F.col("outcome").isNotNull().alias("doomed")
        )
        if not left["open"]:
            break
    return _union(settled), state.filter("root IS NOT NULL").select(F.col("root").alias("name"), "label")


def _next_other(events: DataFrame) -> DataFrame:
    """Adds ``until`` and ``gone``: when the target's first later event of another key is, and its first accepted one.

    The events of a target are sorted, in one task; they are never gathered.
    """
    later = W.partitionBy("target").orderBy(F.desc("seq"))
    so_far, before = later.rowsBetween(W.unboundedPreceding, 0), later.rowsBetween(W.unboundedPreceding, -1)
    accepted = F.col("outcome") == "accepted"
    near = events.withColumns(
        {
            "next_key": F.lag("key").over(later),
            "next_seq": F.lag("seq").over(later),
            "sure_key": F.last(F.when(accepted, F.col("key")), ignorenulls=True).over(before),
            "sure_seq": F.last(F.when(accepted, F.col("seq")), ignorenulls=True).over(before),
        }
    )
    until = F.last(F.when(F.col("next_key") != F.col("key"), F.col("next_seq")), ignorenulls=True).over(so_far)
    gone = F.last(F.when(accepted & (F.col("sure_key") != F.col("key")), F.col("sure_seq")), ignorenulls=True).over(so_far)
    return near.withColumns({"until": until, "gone": gone}).drop("next_key", "next_seq", "sure_key", "sure_seq")


def _holders(sure: DataFrame, several: bool) -> DataFrame:
    """Per key its last accepted claim: who holds it, and until when.

    ``several``: some keys have several owners at first. The target named is then the one that holds longest, and
    ``until_other`` and ``gone_other`` are the latest of all the others.
    """
    none = F.lit(None).cast("long")
    if not several:
        last = sure.groupBy("key").agg(*(F.max_by(c, "seq").alias(name) for c, name in (("target", "holder"), ("until", "until"), ("gone", "gone"))))
        return last.withColumns({"until_other": none, "gone_other": none})
    last = sure.groupBy("key").agg(F.max(F.struct("seq", "until", "gone", "target")).alias("h"))
    columns = ["key", F.col("h.target").alias("holder"), F.col("h.until").alias("until"), F.col("h.gone").alias("gone")]
    owners = sure.filter(F.col("seq") == START).join(last.filter(F.col("h.seq") == START).select("key", "h"), "key")
    others = owners.filter("target <> h.target").groupBy("key").agg(F.max("until").alias("until_other"), F.max("gone").alias("gone_other"))
    return last.join(others, "key", "left").select(*columns, "until_other", "gone_other")


def settle_claims(owners: DataFrame, claims: DataFrame, few: int = FEW) -> DataFrame:
    """Claims (seq, target, key) of targets to keys, where ``owners`` (target, key) hold keys at first: (seq, outcome).

    A claim is a ``duplicate`` if another target holds the key when its turn comes; else it is ``not_found`` if no such
    target is among the owners, and ``accepted`` if there is: the target gives up the key it held. Keys that only one target
    has anything to do with are settled at once.
    """
    known = owners.select("target").distinct().withColumn("known", F.lit(True))
    claims = claims.join(known, "target", "left").select("seq", "target", "key", F.coalesce("known", F.lit(False)).alias("known"))
    first = owners.select(F.lit(START).alias("seq"), "target", "key", F.lit(True).alias("known"))
    events = claims.unionByName(first)
    events, size = written(events, "claims", n=F.count(F.lit(1)))
    if size["n"] <= few:
        return _loop_claims(events)
    sides = events.groupBy("key").agg((F.min("target") != F.max("target")).alias("disputed"), (F.count_if(F.col("seq") == START) > 1).alias("several"))
    alone = F.when(F.col("known"), "accepted").otherwise("not_found")
    outcome = F.when(F.col("seq") == START, "accepted").when(~F.col("disputed"), alone)
    columns = ["seq", "target", "key", "known", "disputed", "outcome"]
    begun = events.join(sides, "key").withColumn("outcome", outcome)
    open_rows = F.count_if(F.col("outcome").isNull())
    begun, left = written(begun.select(*columns, "several"), "claims", open=open_rows, several=F.count_if("several"))
    several = left["several"] > 0
    parts = [begun.select(*columns)]
    while left["open"]:
        waiting = parts[-1].filter("outcome IS NULL")
        stands = _union([part.filter("outcome = 'accepted'") for part in parts])
        timed = _next_other(stands.unionByName(waiting.filter("known")))
        timed = timed.withColumns({"until": _from(F.col("until")), "gone": _from(F.col("gone"))})
        holders = _holders(timed.filter("disputed AND outcome = 'accepted'"), several)
        own = F.col("holder") == F.col("target")
        held = F.when(own, F.col("until_other")).otherwise(F.col("until"))
        gone = F.when(own, F.col("gone_other")).otherwise(F.greatest("gone", F.coalesce("gone_other", F.lit(START))))
        now = (
            F.when(F.col("seq") < F.coalesce(held, F.lit(START)), "duplicate")
            .when(own & F.col("until_other").isNull() & (F.col("seq") < F.col("until")), "accepted")
        )
        placed = waiting.join(holders, "key", "left").withColumns({"now": now, "free": F.col("seq") > F.coalesce(gone, F.lit(START))})
        judged, _ = written(placed.select("seq", "target", "key", "known", "now", "free"), "claims")
        # The first open claim of a known target, and the first unknown one that may have come while the key was held.
        fronts = judged.filter("now IS NULL").groupBy("key").agg(
            F.min(F.when(F.col("known"), F.col("seq"))).alias("front"), F.min(F.when(~F.col("known") & ~F.col("free"), F.col("seq"))).alias("stuck")
        )
        turn = F.col("free") & F.col("known") & (F.col("seq") == F.col("front")) & (F.col("seq") < _from(F.col("stuck")))
        in_vain = F.col("free") & ~F.col("known") & (F.col("seq") < _from(F.col("front")))
        decided = judged.join(fronts, "key", "left").withColumns(
            {"disputed": F.lit(True), "outcome": F.coalesce("now", F.when(turn, "accepted").when(in_vain, "not_found"))}
        )
        part, left = written(decided.select(*columns), "claims", open=open_rows)
        parts.append(part)
    return _union([part.filter(F.col("outcome").isNotNull() & (F.col("seq") > START)).select("seq", "outcome") for part in parts])
