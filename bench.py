"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from limpid.plans import registry

HEADLINE = [
    "fd_pair_scores", "fd_detect", "fd_repair", "score_overall", "score_per_column", "score_reports", "gui_metrics", "value_counts", "column_profile", "topk_values", "numeric_stats",
    "histogram", "outliers_mad", "semantic_types", "regex_signature", "clean_numeric", "clean_datetime", "clean_category", "sql_program", "review_sample", "run_aggregate",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["load_counts"](spark, folder).collect()  # code is compiled and files are found before the clock runs
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
