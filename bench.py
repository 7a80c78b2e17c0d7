"""Time every report at one scale; prints a single JSON line.

The stored tables are built first and timed on their own (``build_*``), since many reports read them.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans.reports import REPORTS, close, report, warehouse  # noqa: E402

TABLES = ("lifecycles", "stg_subscriptions", "events", "days", "int_subscriptions", "borders", "int_usage", "fct")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the JVM's readers

    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    tables = warehouse(spark, sf_dir)
    for table in TABLES:
        timed(f"build_{table}", lambda: getattr(tables, table))
    for name in REPORTS:
        timed(name, lambda: report(name, spark, sf_dir).write.format("noop").mode("overwrite").save())
    close()
    spark.stop()
    line = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
