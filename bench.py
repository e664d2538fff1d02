"""Time the registered queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Every result row is computed and discarded (noop sink); a query's time includes building and planning it. One
untimed pass over the smallest tables beside $BENCH_SF_DIR, where there are any, warms the JVM up. Times are medians of three.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from cashplan.plans import registry


RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    picked = sys.argv[1:] or list(queries)

    def run(name: str, tables: str) -> float:
        started = time.perf_counter()
        queries[name](spark, tables).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    warm_up = os.path.join(os.path.dirname(os.path.normpath(sf_dir)), "sf0.001")
    if os.path.isdir(warm_up):
        for name in picked:
            run(name, warm_up)
    seconds = {name: statistics.median(run(name, sf_dir) for _ in range(RUNS)) for name in picked}
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
