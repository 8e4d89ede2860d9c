"""Times the headline queries, the median of three runs after a first one, and prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from pathfield.plans.catalogue import QUERIES

NAMES = ["msd_ensemble", "psi_local", "track_labels", "dedupe", "interpolate", "rn_corr", "g_r", "noise_velocity"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        times = []
        for _ in range(4):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
