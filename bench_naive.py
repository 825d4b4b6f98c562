"""Time the plain form of three reports against the analyses, on the same fact.

The plain forms sort the whole fact in one task (quartiles, NTILE) or join every
downtime start with every later end. Usage: bench_naive.py [flat fact folder];
without one the fact comes from $BENCH_SF_DIR.
"""

from __future__ import annotations

import json
import statistics
import sys
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bench import RUNS, SF_DIR, consume, session
from freightlens.functions import whole_hours
from freightlens.plans import analyses
from freightlens.sources import load_shipments, read_fact, stored


def plain_outliers(facts: DataFrame) -> DataFrame:
    v = "loading_unloading_time"
    ranked = facts.select(
        v,
        F.row_number().over(Window.orderBy(v)).alias("rn"),
        F.count("*").over(Window.partitionBy()).alias("n"),
    )
    q1, q3 = (
        F.max(F.when(F.col("rn") == F.ceil(F.col("n") * p), F.col(v))) for p in (0.25, 0.75)
    )
    fence = ranked.agg((q3 + (q3 - q1) * 1.5).alias("f")).scalar()
    return facts.filter(F.col(v) > fence).orderBy(F.desc(v), "shipment_id").limit(50)


def plain_deciles(facts: DataFrame) -> DataFrame:
    order = Window.orderBy("supplier_reliability_score", "shipment_id")
    tiled = facts.withColumn("decile", F.ntile(10).over(order))
    return tiled.groupBy("decile").agg(F.avg("lead_time_days"), F.count("*"))


def plain_downtime(facts: DataFrame) -> DataFrame:
    state, at = F.col("handling_equipment_availability"), F.col("timestamp")
    prev = F.lag(state).over(Window.orderBy("timestamp", "shipment_id"))
    steps = facts.select(at.alias("at"), state.alias("state"), prev.alias("prev"))
    starts = steps.filter("state = 0 AND prev = 1").select(F.col("at").alias("s")).distinct()
    ends = steps.filter("state = 1 AND prev = 0").select(F.col("at").alias("e")).distinct()
    spans = starts.join(ends, F.col("e") > F.col("s")).groupBy("s").agg(F.min("e").alias("e"))
    hours = whole_hours(F.col("s"), F.col("e"))
    return spans.groupBy(F.year("s"), F.month("s")).agg(F.avg(hours), F.count("*"))


PAIRS = {
    "outliers": (plain_outliers, analyses.loading_outliers),
    "deciles": (plain_deciles, analyses.supplier_deciles),
    "downtime": (plain_downtime, analyses.equipment_downtime),
}


def timed(facts: DataFrame, report) -> float:
    start = time.perf_counter()
    consume(report(facts))
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    if len(sys.argv) > 1:
        facts = read_fact(spark, sys.argv[1])
    else:
        facts = stored(load_shipments(spark, SF_DIR), "fact")
    result = {"rows": facts.count()}
    for name, forms in PAIRS.items():
        for label, report in zip(("plain", "rewritten"), forms):
            if label == "plain" and name == "downtime" and result["rows"] > 1_000_000:
                continue  # pairs grow with the square of the rows
            timed(facts, report)
            seconds = [timed(facts, report) for _ in range(RUNS)]
            result[f"{name}_{label}"] = round(statistics.median(seconds), 2)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
