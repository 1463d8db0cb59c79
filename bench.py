"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lexibond.plans.queries import all_queries

HEADLINE = ["vocab_all_sizes", "ngram_counts_2", "ngram_counts_5", "ngram_table_sizes", "total_ngrams_per_size", "token_vocab", "encoded_ids", "pmi_score_3", "max_segmentation_5", "merged_counts_2", "batch_pruned_counts_2", "event_sequence_pmi", "log_pairing", "human_units"]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for key, value in {
        "spark.sql.shuffle.partitions": str(2 * cpus),
        "spark.driver.memory": "12g",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{root}/documents.parquet").selectExpr("count(*)").collect()  # starts the engine
    times = {}
    for name in HEADLINE:
        begun = time.perf_counter()
        queries[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
