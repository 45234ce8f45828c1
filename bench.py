"""Times the headline queries on local Spark and prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     number of local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "mention_share",
    "mention_share_by_stage_filter",
    "avg_position",
    "sentiment_breakdown",
    "citation_domains",
    "stage_breakdown",
    "kpi_summary",
    "insights",
    "parse_mentions",
    "text_citations",
    "citation_source_switch",
    "ingest_grounding_json",
    "run_summary",
    "pipeline_mentions",
    "latest_response",
    "cascade_delete_counts",
    "append_with_ids",
    "add_prompts",
    "update_prompts",
)


def main() -> None:
    from answerlens.session import local_session
    from workload.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    wanted = sys.argv[1:] or HEADLINE

    # One untimed query, so that the first timed one does not pay for starting up.
    QUERIES["mention_share"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    timings = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    total = round(sum(timings.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
