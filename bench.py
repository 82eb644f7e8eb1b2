"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from evalweave.checks import queries
from evalweave.session import local_session

HEADLINE = (
    "x13_evaluate_runs",
    "x14_leaderboard",
    "x15_type_stats",
    "d19_clustered_ci",
    "d22_pair_signs",
    "c13_complete_runs",
    "x1_sanity_report",
    "x3_validated_items",
    "x4_balanced_pick",
    "e6_round_robin_capped",
    "x5_mark_equal_texts",
    "x5_mark_duplicates",
    "x11_build_tasks",
    "x12_ingest_outputs",
    "a1_scan_jsonl",
    "i1_incremental_resume",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    registered = queries()
    # Start the JVM paths and Python workers before timing.
    registered["h4_strip_fences"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
