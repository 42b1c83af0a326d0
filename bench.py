"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query runs twice into the
no-op sink; the faster run counts.
"""

from __future__ import annotations

import json
import os
import time

from scoremill.plans.registered import QUERIES
from scoremill.session import drop_staged, local_session

HEADLINE = (
    "newest_event_scores",
    "newest_lineitem_scores",
    "newest_lineitem_records",
    "overlay",
    "fill_without_overwrite",
    "suite_average",
    "lineitem_suite_average",
    "average_of_averages",
    "dashboard_results",
    "dashboard_cells",
    "results_table",
    "missing_tasks",
    "work_list",
    "row_means",
    "lineitem_stats",
    "top_lineitems",
    "find_experiments",
    "experiment_listing",
    "path_table",
    "folder_counts",
    "settings_diff",
    "many_settings_diff",
    "token_counts",
    "mix_plan",
    "top_domains",
)
RUNS = 2


def scale(sf_dir: str) -> float | str:
    name = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "scoremill-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    drop_staged(spark)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of the faster of two runs",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": scale(sf_dir),
            }
        )
    )


if __name__ == "__main__":
    main()
