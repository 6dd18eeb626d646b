"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times (default 1) over whole tables; every row of its result
is computed and thrown away. The reported number is the median run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfwise.session import build_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "title_metrics",
    "title_metrics_wide",
    "title_metrics_frame",
    "metrics_one_prefix",
    "prefix_summary",
    "loans_by_title",
    "classify_titles",
    "summary_by_prefix",
    "kpi_summary",
    "top_writeoff",
    "unclear_cases",
    "title_subjects",
    "subject_vocabulary",
    "enriched_operations",
    "validate_build",
    "ingest_operations",
)


def run_once(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "shelfwise-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        **{"spark.ui.showConsoleProgress": "false"},
    )
    seconds: dict[str, float] = {}
    for name in wanted:
        run_once(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
