"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: warm, median of three. Prints one JSON line.

The star is stored once, as a warehouse would; `store_star` is what that takes, `join_star_derived` a query without it."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from astrolabe.plans import catalogue, star

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [k for k in catalogue.QUERIES if k.startswith("ssb_")] + ["join_star_multiway", "join_invisible_semi", "join_star_derived", "agg_group_by", "agg_cube", "sort_three_keys"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    began = time.perf_counter()
    star.at(spark, FOLDER)
    took["store_star"] = round(time.perf_counter() - began, 4)
    for name in HEADLINES:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(median(runs[1:]), 4)
    spark.stop()
    total = sum(v for k, v in took.items() if k.startswith("ssb_"))
    print(json.dumps({"metric": "sum of the 13 star-schema queries, warm, median of 3", "value": round(total, 4), "unit": "sec", "queries": took, "sf": FOLDER.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
