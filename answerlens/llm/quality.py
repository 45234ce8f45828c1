"""Quality rules with risk-controlled thresholds. DataFrame and SQL functions only.

Each rule looks at one measure of a text. Its cutoff is chosen per stratum (language) on labelled documents:
going from lenient to strict, a cutoff is accepted while the exact binomial test rejects the hypothesis that more than
``MOST_REJECTED / number of rules`` of the good documents fail it. The sequence of a rule and stratum is tested in that
fixed order, and rules and strata share the error probability ``ERROR`` evenly (Bonferroni). So with probability
``1 - ERROR`` no stratum loses more than ``MOST_REJECTED`` of its good documents to the rules. Where labels are too few to
show that, the rule is off. Cutoffs are fixed grids, so nothing else is learnt from the labels.

Measures are taken in one pass, within the row, and written (a few numbers a document). Of the labels only counts by
stratum, rule and grid step are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, settled

MOST_REJECTED = 0.05
ERROR = 0.05
REPEATED = 5
STEPS = 40
MOST_BROADCAST = 10_000

# Rule: (measure, cutoff of a step from lenient to strict). A document fails if the measure is above the cutoff.
RULES = {
    "symbols": ("try_divide(n_symbols, word_chars)", "(41 - step) / 100D"),
    "capitals": ("try_divide(n_capitals, word_chars)", "(41 - step) / 50D"),
    "repeated_lines": ("try_divide(n_dup_lines, n_lines)", "(41 - step) / 40D"),
    "repeated_words": ("try_divide(n_repeat_words, n_words)", "(41 - step) / 40D"),
    "few_words": ("1 - try_divide(n_distinct_words, n_words)", "1 - step / 200D"),
    "long_words": ("try_divide(word_chars, n_words)", "4 + (41 - step) / 4D"),
    "short_words": ("-try_divide(word_chars, n_words)", "-1 - step / 10D"),
}


def _repeats(n: int = REPEATED) -> list[tuple[str, Column]]:
    """Columns, one after the other, for the number of words in windows of n words that a text has twice or more."""
    hashes = F.transform(
        F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(n))),
    )
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ordered = F.when(again, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    twice = F.filter(
        "ordered", lambda x, k: (F.get("ordered", k - 1)["h"] == x["h"]) | F.coalesce(F.get("ordered", k + 1)["h"] == x["h"], F.lit(False))
    )
    places = F.array_sort(F.transform("twice", lambda x: x["i"]))
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("places") - 1),
        F.lit(0).cast("long"),
        lambda total, k: total + F.least(F.lit(n), F.coalesce(F.get("places", k + 1) - F.get("places", k), F.lit(n))),
    )
    return [("hashes", hashes), ("ordered", ordered), ("twice", twice), ("places", places), ("n_repeat_words", F.when(F.size("places") > 0, covered).otherwise(F.lit(0).cast("long")))]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Per row: doc_id, stratum and the counts the rules are made of. A null text has no words and one empty line."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    word = r"[^\x20\x09-\x0D]"
    rows = rows.withColumns({"words": F.regexp_extract_all("text", F.lit(f"{word}+"), 0), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(word))})
    for name, column in _repeats():
        rows = rows.withColumn(name, column)
    n = F.size("words")
    return rows.select(
        "doc_id",
        F.col("lang").alias("stratum"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
    )


def failed_steps(measured: DataFrame) -> DataFrame:
    """Adds ``steps``: for each rule, in order, the first step of its grid that the document fails (null: none).

    Cutoffs fall evenly, so the step comes from a division; its neighbours are tested, for the division rounds.
    """
    names = [f"_measure_{rule}" for rule in RULES]
    valued = measured.withColumns({name: F.expr(f"coalesce({measure}, 0D)") for name, (measure, _) in zip(names, RULES.values(), strict=True)})
    arrays = []
    for name, (_, cutoff) in zip(names, RULES.values(), strict=True):
        at_0, at_1 = (cutoff.replace("step", step) for step in ("0", "1"))
        guess = f"cast(least(greatest(floor(({at_0} - {name}) / (({at_0}) - ({at_1}))), -1), {STEPS}) as int)"
        tested = []
        for more in (0, 1, 2):
            step = f"({guess} + {more})"
            tested.append(f"CASE WHEN {step} BETWEEN 1 AND {STEPS} AND {name} > {cutoff.replace('step', step)} THEN {step} END")
        arrays.append(F.expr(f"coalesce({', '.join(tested)})"))
    return valued.withColumn("steps", F.array(*arrays)).drop(*names)


def binomial_tail(failed: Column, n: Column, share: Column) -> Column:
    """P(X <= failed) for X binomial (n, share), summed in logarithms."""
    first = n * F.log1p(-share)
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(done, i):
        term = done["term"] + F.log((n - i + 1) / i) + F.log(share / (1 - share))
        most = F.greatest(done["total"], term)
        return F.struct(term.alias("term"), (most + F.log1p(F.exp(-F.abs(done["total"] - term)))).alias("total"))

    some = F.aggregate(F.sequence(F.lit(1).cast("long"), failed), start, add, lambda x: F.exp(x["total"]))
    return F.when(failed > 0, some).otherwise(F.exp(first))


def thresholds(measured: DataFrame, labels: DataFrame, most_rejected: float = MOST_REJECTED, error: float = ERROR) -> DataFrame:
    """Per stratum with labels: ``accepted``, for each rule in order the strictest accepted step (null: the rule is off).

    Labels of null, and of ids without a document, are not used; repeated labels count once, repeated documents of an id each.
    A null stratum is that of the empty string. Without labels, or with an empty table, there is no row.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = settled(failed_steps(measured.join(good, "doc_id")).select("stratum", "steps"), "quality-steps")
    strata = settled(held.groupBy("stratum").agg(F.count("*").alias("n")), "quality-strata")
    counts = held.select("stratum", F.posexplode_outer("steps").alias("rule", "step")).groupBy("stratum", "rule", "step").agg(F.count("*").alias("failed"))
    # A small table: strata x rules x steps. A document that fails a step fails all stricter ones.
    rules = F.explode(F.sequence(F.lit(0), F.lit(len(RULES) - 1))).alias("rule")
    cells = strata.select("stratum", "n", rules).select("stratum", "n", "rule", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step"))
    many = counts.groupBy("stratum", "rule").agg(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", "failed"))).alias("by_step"))
    cells = cells.join(many, ["stratum", "rule"], "left").withColumn(
        "failed", F.expr("aggregate(coalesce(by_step, array()), 0L, (t, x) -> t + if(x.step <= step, x.failed, 0L))")
    )
    share = F.lit(most_rejected / len(RULES))
    limit = F.lit(error / (len(RULES) * max(1, strata.count())))
    passed = cells.where(F.col("failed") <= share * F.col("n")).where(binomial_tail(F.col("failed"), F.col("n"), share) <= limit)
    best = passed.groupBy("stratum", "rule").agg(F.max("step").alias("step"))
    pairs = best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "step"))).alias("by_rule"))
    return pairs.select("stratum", F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), lambda k: F.try_element_at("by_rule", k)).alias("accepted"))


def judge(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds ``failed_rules`` (names, in the order of the rules) by the accepted cutoffs of a document's stratum.

    A stratum without cutoffs fails no rule. Every row is judged for itself, so ids may repeat or be null; an empty table
    gives no row.
    """
    chosen = settled(chosen, "quality-cutoffs")
    if chosen.count() <= MOST_BROADCAST:
        chosen = F.broadcast(chosen)
    names = F.array(*(F.lit(x) for x in RULES))
    fails = F.transform(
        F.sequence(F.lit(0), F.lit(len(RULES) - 1)), lambda k: F.when(F.get("steps", k) <= F.get("accepted", k), F.get(names, k))
    )
    joined = failed_steps(measured).join(chosen, "stratum", "left")
    return joined.withColumn("failed_rules", F.when(F.col("accepted").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(fails)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the counts of the base rules, their verdict and that of the risk-controlled rules."""
    measured = settled(measures(documents(spark, sf_dir)), "quality-measures")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judge(measured, thresholds(measured, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & (F.size("failed_rules") == 0)).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"),
    )
