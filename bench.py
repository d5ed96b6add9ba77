"""Times the headline queries once each, after one warm-up run; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["fold_bins", "visible_mean_baseline", "cells_k", "k_percentiles", "daily_totals", "window_series_dense", "training_retention", "group_specs", "mask_reference", "eval_strata", "bin_quantiles", "boundary_audit", "gap_counts", "geometry_resolve", "two_stage_sample"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from wayfold.plans.queries import QUERIES

    times = {}
    QUERIES["visible_mean_baseline"](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
