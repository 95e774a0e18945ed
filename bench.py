"""Times the headline queries; prints one JSON line."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from spanlake.operators import intervals
from spanlake.plans.queries import QUERIES
from spanlake.schema import SECOND, events
from spanlake.sources import buckets

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
NAMES = ["scan_clipped", "flood", "period_union", "period_intersect", "merge_by_keys", "chunk_by_key", "categorize", "split_url", "sum_durations", "desktop_app_events"]


def generated(spark: SparkSession, n: int) -> DataFrame:
    """n events of 10 s at 1 s spacing with 20 distinct payloads."""
    return events(spark.range(n), F.lit("b"), F.col("id"), F.col("id") * SECOND, F.lit(10 * SECOND), F.concat(F.lit('{"number":'), F.col("id") % 20, F.lit("}")))


EXTRA = {"generated_scan_5000": lambda spark, _: buckets.scan(generated(spark, 5000), "b"), "generated_intersect_1000": lambda spark, _: intervals.period_intersect(generated(spark, 1000), generated(spark, 1000))}


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in [*NAMES, *EXTRA]:
        query = EXTRA[name] if name in EXTRA else QUERIES[name][0]
        runs = []
        for _ in range(2):  # the first one warms up
            began = time.perf_counter()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "warm seconds, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
