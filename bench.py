"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and run to completion into Spark's ``noop`` sink (full execution,
no collect) $BENCH_REPEAT times (default 3); the reported time per query is the median
run, and the first (cold: code generation included) run is reported alongside. Prints
one JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "model_summary",        # parse -> essays -> ICC -> routing -> pivot (the analysis)
    "hitl_routing",         # essay metrics + routing at essay grain
    "icc_by_model",
    "severity_ttest",
    "bland_altman",
    "topic_delta",
    "parse_failure_rate",
    "clean_records",        # normalise / classify / dedupe whole documents
    "clean_counters",
    "normalize_text",
    "sample_per_question",
    "score_plan",
    "resume_antijoin",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from raterkit.plans.queries import QUERIES
    from raterkit.plans.tables import SCAN_PARTITIONS
    from raterkit.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="raterkit-bench")
    # the test files are one row group each: deal their rows out over the cores after the scan
    spark.conf.set(SCAN_PARTITIONS, cpus)
    names = sys.argv[1:] or HEADLINE
    # warm-up: JVM and code generation caches
    QUERIES["total_score"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    times, first = {}, {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
        first[name] = round(runs[0], 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "method": f"median of {repeat} runs per query (build + execute into noop), after one warm-up query",
        "first_run": first,
        "first_run_total": round(sum(first.values()), 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
