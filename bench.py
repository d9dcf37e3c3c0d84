"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3). Each query is fully executed into Spark's ``noop``
sink (every row computed, nothing collected to the driver); the value per
query is the median wall time of the warm runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scanledger.plans import catalog  # noqa: E402
from scanledger.session import build_session  # noqa: E402

HEADLINE = [
    "lifecycle_replay",
    "severity_counts_by_repo",
    "secret_scan_documents",
    "license_scan_documents",
    "sarif_results",
    "advisory_join",
    "normalize_reports",
    "lifecycle_merge_last_run",
    "issue_work_list",
]


def run_once(spark, name, sf_dir) -> float:
    t0 = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus)
    results, errors = {}, {}
    for name in HEADLINE:
        try:
            run_once(spark, name, sf_dir)  # warm-up
            results[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3)
        except Exception as exc:  # keep one JSON line even if a query fails; report it
            results[name] = None
            errors[name] = str(exc).splitlines()[0][:200]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_median_total",
        "value": round(sum(v for v in results.values() if v is not None), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
