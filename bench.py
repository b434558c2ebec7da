"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose the data, the threads and the
timed runs per query.  The median is reported after one warm run; a training
run, which is many jobs over cached rows, is timed once and cold.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from checks.session import session  # noqa: E402

HEADLINE = (
    "profile", "missing_counts", "correlation_matrix", "quartiles", "dedupe_rows", "remove_outliers",
    "title_case", "infer_types", "round_floats", "apply_strategy", "auto_clean", "clean",
    "suggest_strategy", "recent_runs", "split_exact", "features", "knn_join", "silhouette_squared",
    "train_classification",
)


def run(spark, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    took = {}
    for name in names:
        if name.startswith("train_"):
            took[name] = round(run(spark, sf_dir, name), 3)
        else:
            run(spark, sf_dir, name)
            took[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(runs)), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
