"""Runs the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "search_equals", "search_window", "search_keyword", "search_regex", "search_in_subsearch", "eval_chain", "rex_stage", "stats_all", "stats_moments", "timechart_fill",
    "timechart_other", "top_stage", "eventstats_stage", "streamstats_running", "anomaly_zscore", "dedup_newest", "join_datasets", "lookup_stage", "transaction_pause", "sequence_stage",
    "funnel_stage", "prevalence_stage", "services_view", "metric_rollup", "risk_scores",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from rivulet.queries import QUERIES

    took = {}
    for name in sys.argv[1:] or HEADLINE:
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # compiles code and warms caches
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
