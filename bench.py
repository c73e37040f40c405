"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the headline set).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from recspark.plans import catalog
from recspark.session import build_session

HEADLINE = (
    "legal_train",
    "chronological_train",
    "hard_filter",
    "popularity",
    "itemcf_fit",
    "itemcf_retrieve",
    "dense_retrieve",
    "tfidf_documents",
    "candidate_union",
    "candidate_features_v1",
    "fuse_minmax_linear",
    "method_aggregates",
    "als_retrieve",
    "graph_propagate",
    "fold_preferences",
    "tfidf_constrained",
    "paired_bootstrap",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session(
        f"local[{cpus}]", max(8, 2 * int(cpus) if cpus.isdigit() else 16),
        **{"spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(found.group(1)) if found else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
