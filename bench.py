"""Headline queries at one scale: prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
QUERIES = (
    "flagship scan_select_drop_rename filter_equals filter_greater filter_contains filter_expression add_column lag_lead join_inner join_left join_outer join_star "
    "group_count group_sum group_mean group_agg_multi_key group_first group_transform pivot_mean melt distinct_rows rolling_mean rolling_std ewma sort_top tail "
    "stats_column describe_frame percentiles mode pearson_covariance correlation_matrix anova scale_standard scale_robust encode_label encode_target impute_median bins_quantile "
    "metrics_classification roc_auc tokens_whitespace count_vectors tfidf vector_search_cosine vector_search_dot nearest_neighbours kmeans_assign decompose forecast_holt_winters ols window_tumbling"
).split()


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    from brightloom.queries.catalog import QUERIES as known

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in QUERIES:
        times = []
        for run in range(RUNS + 1):  # the first warms up
            start = time.perf_counter()
            known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 4)
    sf = re.search(r"sf([\d.]+)", SF_DIR)
    print(json.dumps({"metric": "total of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
