"""Time every analysis over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each analysis runs $BENCH_RUNS times after one warm-up of the whole set's common
path, and the median counts. A run covers everything from reading the tables to
consuming all result rows, including intermediate tables.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from freightlens.plans import ANALYSES, run

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("freightlens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    consume(run(name, spark, SF_DIR))
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    for warm in ("q01_fuel_by_risk", "q10_supplier_deciles", "q20_equipment_downtime"):
        timed(spark, warm)
    seconds = {
        name: round(statistics.median(timed(spark, name) for _ in range(RUNS)), 3)
        for name in ANALYSES
    }
    print(
        json.dumps(
            {
                "metric": "total_median_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": int(CPUS),
                "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
