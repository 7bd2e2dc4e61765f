"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from quillon.plans.queries import QUERIES

HEADLINE = [
    "select_computed", "filter_and_or_not", "filter_null_strict_or", "integer_division", "join_inner", "join_full_coalesced_key", "join_composite_key", "groupby_aggregates",
    "groupby_expression_key", "sum_all_null_zero", "udaf_median", "distinct_on_first", "rolling_sum", "rolling_partitioned", "cumulative_sum_global", "shift_lag", "rank",
    "rank_null_key", "sort_multi_null_order", "top_k", "numbered_rows", "concat_vertical_fill", "series_align_add", "row_dot", "row_cosine_topk", "normalize_zscore",
    "tokenize_counts", "vocab_topn", "event_time_window",
]
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, failed = {}, {}
    for name in HEADLINE:
        took = []
        try:
            for _ in range(RUNS):
                began = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - began)
                spark.catalog.clearCache()
            seconds[name] = round(statistics.median(took), 4)
        except Exception as e:  # noqa: BLE001  one query's failure is told, the others still run
            failed[name] = str(e)[:200]
    print(json.dumps({"metric": f"sum of the median seconds of {len(seconds)} queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2], **({"failed": failed} if failed else {})}))
    spark.stop()
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
