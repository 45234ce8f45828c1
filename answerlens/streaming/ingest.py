"""The pipeline as a stream over a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from answerlens.plans.pipeline import run_pipeline
from answerlens.schemas import LANDING
from answerlens.sources.store import FactStore


def ingest(
    store: FactStore,
    brands: DataFrame,
    landing_path: str,
    checkpoint_path: str,
    stream: str,
    skip_existing: bool = False,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Process all landing files not seen so far, then stop.

    Each micro-batch is a run of its own, named by the stream and the number of the batch. A batch that is
    repeated after a failure replaces its run, so answers are stored exactly once. Streams into one store need
    names of their own; a stream that starts anew, without its checkpoint, under its old name replaces its runs.
    """

    def store_batch(batch: DataFrame, number: int) -> None:
        run_pipeline(batch, brands, store, f"{stream}-{number}", skip_existing=skip_existing)

    landed = (
        store.spark.readStream.schema(LANDING).option("maxFilesPerTrigger", files_per_batch).json(landing_path)
    )
    return (
        landed.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
