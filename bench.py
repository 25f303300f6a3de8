"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

#: Relate, predicates, overlay and joins over whole tables.
HEADLINE = ("box_relate", "box_predicates", "box_overlay", "box_join_histogram", "point_location", "triangle_location", "segment_crossings", "line_boxes", "score_summary")


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from terrazzo.plans.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, rows = {}, {}
    for name in HEADLINE:
        began = time.time()
        rows[name] = QUERIES[name](spark, sf_dir).count()
        took[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "rows": rows}))


if __name__ == "__main__":
    main()
