"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES``
a comma-separated choice (``all`` for every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from codestrata.plans import corpora, registry
from codestrata.session import local_session

HEADLINE = [
    "language_metrics", "file_metrics", "project_metrics", "classify_lines", "line_smells", "quality_summary",
    "scan_secrets", "security_totals", "security_top", "lint_summary", "dependencies", "check_dependencies",
    "vuln_summary", "detect_all", "technologies_ext", "file_types", "exclude_by_repo", "collect_files", "fit_budget",
    "classify_binary", "summarize", "render_summary", "file_tokens", "project_stats", "tree_text", "tree_dot",
    "prompt_text", "pack_batches", "chunk_files", "recent_changes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = registry.queries()
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")

    started = time.perf_counter()
    for name in corpora.CORPORA:
        corpora.load(spark, sf_dir, name)
    ingest = time.perf_counter() - started

    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)

    print(json.dumps({
        "metric": "source_corpus_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "ingest_sec": round(ingest, 3), "sf": sf_dir.rstrip("/").split("sf")[-1], "cpus": cpus,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
