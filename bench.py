"""Headline-query benchmark: prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs its full plan into the no-op sink (no driver collection): once to
warm up, then three times (long ones once); the median counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["merged_labelled", "daily_pivot_avg", "outer_merge", "forward_fill", "describe",
            "skew_table", "corr_matrix", "split_70_15_15", "minmax_by_split", "rolling_mean7",
            "sequence_windows", "leak_report", "score_metrics", "ridge_two_feature",
            "high_water_append", "pivot_all", "histogram20", "stream_daily_avg", "linear_eval", "forest_fit",
            "describe_events"]
RUNS = 3
LONG = 15.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from aeris.plans.catalogue import QUERIES
    from aeris.session import build_session, local_conf
    spark = build_session(f"local[{cpus}]", "aeris-bench", local_conf(cpus))
    times = {}
    for name in HEADLINE:
        # the first run warms code and file listing of this query and does not count;
        # a query of many seconds is timed once
        spent = []
        while len(spent) < (1 + RUNS if not spent or spent[0] < LONG else 2):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - t0)
        times[name] = round(median(spent[1:]), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else None, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
