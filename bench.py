"""Headline queries, one JSON line: seconds per query (median of three runs after one shared warm-up) and their sum."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from clinrisk.catalog.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "engineer_features", "range_violations", "outliers_iqr", "outliers_iqr_lineitem", "split_stratified", "cv_folds",
    "prep_fit_transform", "corr_matrix_lineitem", "lr_fit", "score_batch", "score_requests", "score_payloads", "metrics_all",
    "roc_auc", "roc_curve", "threshold_search_f1", "latest_version", "last_n_window", "drift", "rate_by_endpoint",
    "latency_quantiles", "alert_latency", "heartbeat_gaps", "train_plan",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("clinrisk-bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for table in ("orders", "events", "lineitem"):
        spark.read.parquet(f"{SF_DIR}/{table}.parquet").write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(median(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(SF_DIR).name}))
    spark.stop()


if __name__ == "__main__":
    main()
