"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 3 timed runs after one warm-up; the median counts).  `BENCH_QUERIES`
may name other queries, separated by commas, or `all`.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetsift.plans.session import configure  # noqa: E402
from verification.queries import QUERIES  # noqa: E402
from verification.session import local_session  # noqa: E402

HEADLINE = [
    "fleet_secret_counts", "p03_kept_files", "d01_secret_findings", "w01_parsed_steps", "m08_all_misconfigs",
    "s03_python_audit", "s04_node_audit", "e03_first_per_cve_and_package", "e06_dependency_findings", "e07_advisory_matches",
    "r07_sorted_findings", "j01_previous_scans", "j02_finding_status", "j03_fixed_findings", "k01_sarif_results",
    "k02_sarif_documents", "k04_finding_history", "a01_severity_counts", "a04_rule_definitions", "a09_critical_trend",
    "o02_top_findings", "t02_streamed_summaries",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = configure(local_session("bench"))
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
