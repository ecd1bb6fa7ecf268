"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from codeprism.plans import queries as core
from codeprism.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "clone_families", "clone_fingerprints", "clone_blocks", "benchmark_overlap", "line_counts", "secret_lines", "high_entropy_tokens", "findings_groupings", "audit_new", "churn_halves",
    "file_health", "hotspots", "range_coalesce", "edit_conflicts", "vulnerable_deps", "reachability", "cycles_scc", "changed_coverage", "window_session", "pricing_summary", "cube_orders", "asof_last_purchase",
)


def main() -> None:
    spark = local_session(CPUS, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles
            began = time.time()
            core.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
