"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one JSON line.

Each query runs once to warm up and three times for its median; results go to Spark's
no-op sink, so all rows and columns are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemill.plans import registry
from tidemill.session import session

HEADLINE = (
    "flagship_revenue_by_nation", "tpch_q1", "tpch_q3", "tpch_q4", "tpch_q5", "tpch_q6", "tpch_q9", "tpch_q10", "tpch_q13", "tpch_q14", "tpch_q17", "tpch_q18", "tpch_q19", "tpch_q21", "tpch_q22",
    "agg_cube", "agg_distinct", "win_rank", "win_rows_sliding", "join_anti", "sort_topn", "snapshot_merge_on_read",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")), app="bench")
    found, seconds = registry.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
