"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the tables      (default /root/testdata/sf0.1)
BENCH_CPUS     local executor threads    (default: all)
BENCH_RUNS     timed runs, median taken  (default 3, after one warm-up)
BENCH_ONLY     comma-separated query names, or ``all``
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from grievaline import catalogue  # noqa: E402

HEADLINE = [
    "complaint_batch",
    "unify_output",
    "check_summary",
    "script_language",
    "sliding_chunks",
    "chunk_no_global",
    "change_feed",
    "ticket_json_parse",
    "base64_payloads",
    "assemble_messages",
    "tool_log_array",
    "repeat_suppression",
    "latest_journey",
    "latest_journey_max_by",
    "fill_from_journey",
    "translation_lookup",
    "topk_similarity",
    "topk_l2",
    "rule_search",
    "rag_result",
    "resolution_interval",
    "resolution_cube",
    "feature_drift",
    "token_usage",
    "request_stream",
    "latest_journey_stream",
]


def timed(query, spark: SparkSession, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or "*"
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = os.environ.get("BENCH_ONLY", "")
    queries = catalogue.queries()
    names = list(queries) if only == "all" else only.split(",") if only else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("grievaline-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        if runs > 1:
            timed(queries[name], spark, sf_dir)
        times = [timed(queries[name], spark, sf_dir) for _ in range(runs)]
        seconds[name] = round(statistics.median(times), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": spark.sparkContext.defaultParallelism,
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
