"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice into a no-op sink; the second run counts, cold times are
beside it. A traversal runs once.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quarry.catalog_queries import QUERIES

HEADLINE = ("J7_dead_exports", "G6_domain_crossings", "G8_package_ranking", "G23_W5_ranked_targets", "G1_merge_nodes", "J6_referencing_files", "H19_health", "R2_transitive_importers")
#: Bound by the latency of a job per level; once is enough.
ONCE = {"R2_transitive_importers"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm, cold = {}, {}
    for name in HEADLINE:
        for times in (cold, warm) if name not in ONCE else (warm,):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
            spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
