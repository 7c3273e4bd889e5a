"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line of seconds."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from brindle.plans import catalogue

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "domain_top", "latest_per_key", "runs_records_join", "match_score", "taxonomy_match", "backfill_left_lookup", "dup_documents", "page_candidates", "page_records",
    "run_verdict", "host_pacing", "session_windows", "variants_merge", "price_normalize", "export_fill_rate", "ops_duration_metrics",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first compiles; the best of the others counts
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs[1:]), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": CPUS, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
