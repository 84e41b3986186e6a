"""Time every query once, in one session, and print one JSON line.

Tables and models that several queries share are made by the first query that needs
them, and count towards its time. ``BENCH_QUERIES`` (comma-separated) runs a subset.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from farebox import staging
from farebox.plans.queries import QUERIES


def time_stages() -> dict[str, float]:
    """Seconds spent in each staged table, by its label; filled while queries run."""
    seconds: dict[str, float] = {}

    def timed(df, label, write=staging.stage):
        start = time.perf_counter()
        out = write(df, label)
        seconds[label] = round(seconds.get(label, 0.0) + time.perf_counter() - start, 3)
        return out

    for module in [m for m in sys.modules.values() if getattr(m, "stage", None) is staging.stage]:
        module.stage = timed
    return seconds


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    staged = time_stages()
    seconds = {}
    for name in names.split(",") if names else QUERIES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total seconds of all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                # Part of the times above: writing the tables that several queries share.
                "staged": staged,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    staging.release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
