"""Times the headline queries and prints one JSON line.

Each query is written to the ``noop`` sink, so every row and column is computed.  One
untimed run warms the JVM; ``BENCH_RUNS`` timed runs follow and the median is reported.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stockmill.plans.registry import QUERIES
from stockmill.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
HEADLINE = os.environ.get("BENCH_QUERIES", "").split() or list(QUERIES)


def run(spark, name):
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    spark = build_session(
        "bench", master=f"local[{CPUS}]", shuffle_partitions=CPUS,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "inventory_summary")
    timings = {}
    for name in HEADLINE:
        timings[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
