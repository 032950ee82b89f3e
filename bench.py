"""Bench: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clickwright.plans.catalog import QUERIES, log  # noqa: E402
from clickwright.session import local_session  # noqa: E402

HEADLINE = [
    "expose_ratio", "active_per_grain", "first_last_gap", "rolling_neighbor_counts", "gap_to_last_view",
    "label_encode", "build_features",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")), app="clickwright-bench")
    spark.range(1).collect()  # start the JVM's executor threads (not timed)
    times = {}
    t0 = time.perf_counter()
    log(spark, sf_dir)  # derive and write the log that all feature queries read
    times["log"] = round(time.perf_counter() - t0, 3)
    for name in names:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        if name == "build_features":
            df._jdf.queryExecution().executedPlan()
            times["build_features_planning"] = round(time.perf_counter() - t0, 3)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(t for n, t in times.items() if not n.endswith("_planning")), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
