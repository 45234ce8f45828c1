"""The run: landed answers to fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from answerlens.operators.dictionary import MOST_IN_PLAN, with_dictionary_hits
from answerlens.operators.ids import with_unique_ids
from answerlens.operators.mentions import LITERAL_BRANDS
from answerlens.operators.parsing import run_statistics, with_items
from answerlens.session import written
from answerlens.sources.answers import usable
from answerlens.sources.dimensions import brand_names
from answerlens.sources.store import FactStore


def parse_landing(landing: DataFrame, brands: DataFrame) -> DataFrame:
    """Parsed answers of all usable landing rows, by the way that suits the length of the brand list."""
    answers = landing.filter(usable())
    names = brand_names(brands, LITERAL_BRANDS)
    if names is not None:
        return with_items(answers, brands=names)
    if brand_names(brands, MOST_IN_PLAN) is not None:
        return with_items(answers, hits=with_dictionary_hits(answers, brands))
    # A list of more names is joined on an id, which must not change should a task be repeated.
    keyed, _ = written(with_unique_ids(answers, 0, "_answer_id"), "answers")
    return with_items(keyed, hits=with_dictionary_hits(keyed, brands, "_answer_id"))


def run_pipeline(
    landing: DataFrame,
    brands: DataFrame,
    store: FactStore,
    run_id: str,
    force: bool = False,
    skip_existing: bool = False,
) -> DataFrame:
    """Parse one run of landed answers into the store, commit it and return its statistics.

    ``force`` replaces all facts. ``skip_existing`` leaves out answers whose prompt and platform other runs already
    hold; by default they are stored again, as a further observation.

    Landing rows are read once: how many there are, and how many of them are skipped, is observed on the way to the
    responses, in the stage that writes them.
    """
    held = F.lit(False)
    rows = landing
    if skip_existing and not force:
        others = store.before_run("responses", run_id).select("prompt_id", "platform").distinct()
        rows = landing.join(others.withColumn("_held", F.lit(True)), ["prompt_id", "platform"], "left")
        held = F.coalesce("_held", F.lit(False))
    seen = Observation()
    counted = rows.withColumn("_skip", held).observe(
        seen, F.count(F.lit(1)).alias("landed"), F.count_if(F.col("_skip")).alias("skipped")
    )
    wanted = counted.filter("NOT _skip").select(*landing.columns)
    commit = store.write_run(parse_landing(wanted, brands), run_id, refresh=force, landed=seen)
    return run_statistics(store.runs.filter(F.col("attempt") == commit["attempt"]))
