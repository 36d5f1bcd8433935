"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "near_duplicates", "duplicate_groups", "html_to_text", "split_clauses", "citation_tokens", "candidates", "score_pairs",
    "derive_groups", "reconcile_arrangement", "plan_volumes", "build_plan", "page_labels", "preflight_checks",
    "matter_findings", "compare_builds", "journal_states", "review_changes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from casefile.plans.catalog import load
    from casefile.session import local_session

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    queries = load().queries
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
