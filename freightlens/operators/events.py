"""State changes in one long ordered series, and the event that follows each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.operators.order_stats import range_cuts, with_range_number
from freightlens.sources.scratch import stored


def transition_events(
    df: DataFrame, at: str, tie_break: str, state: str, ranges: int | None = None
) -> DataFrame:
    """Times at which the state differs from the previous row in (at, tie_break) order.

    Returns ``at``, ``prev_state``, ``state`` and ``part``, the time range the change
    was found in (numbered in time order); changes repeated within a range and
    time appear once. NULL states and the very first row have no transition.

    The series is cut into time ranges, each compared row by row on its own.
    Only distinct changes and each range's first and last row are kept; a first
    row then takes its previous state from the range before it. The cuts come from a
    sketch, so rows are dealt to their range by the one shuffle that the comparison
    needs; a moment that many rows share is cut by the tie-break. Sketches and stores
    when called.
    """
    inside = Window.partitionBy("part").orderBy("at", "tie")
    changed = F.col("state") != F.col("prev_state")
    series = df.select(
        F.col(at).alias("at"), F.col(tie_break).alias("tie"), F.col(state).alias("state")
    )
    parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = range_cuts(series, "at", "tie", parts)
    compared = (
        with_range_number(series, "part", "at", "tie", cuts)
        .withColumns(
            {
                "prev_state": F.lag("state").over(inside),
                "opens": F.row_number().over(inside) == 1,
                "closes": F.lead("tie").over(inside).isNull(),
            }
        )
        .filter(F.col("opens") | F.col("closes") | changed)
    )
    # Still partitioned by range, so this collapses without a shuffle.
    kept = stored(
        compared.groupBy("part", "at", "prev_state", "state", "opens", "closes").agg(
            F.max("tie").alias("tie")
        ),
        "state-changes",
    )

    # At most two rows per range, so one task can hold them all.
    across = Window.orderBy("part", "at", "tie")
    opening = (
        kept.filter(F.col("opens") | F.col("closes"))
        .withColumn("prev_state", F.lag("state").over(across))
        .filter("opens")
    )
    return (
        kept.filter(~F.col("opens"))
        .unionByName(opening)
        .filter(changed)
        .select("at", "prev_state", "state", "part")
    )


def next_event_after(changes: DataFrame, starts: Column, ends: Column) -> DataFrame:
    """Pair each distinct start time with the earliest strictly later end time.

    ``changes`` has ``at`` and an ordered ``part``; starts without a later end are
    dropped. Times are made distinct first, so each range is walked once,
    backwards, and ranges pass on only the first end found after them.
    """
    times = (
        changes.filter(F.col("at").isNotNull())
        .groupBy("at")
        .agg(
            F.min("part").alias("part"),
            F.max(starts).alias("starts"),
            F.max(F.when(ends, F.col("at"))).alias("end_at"),
        )
    )
    later_here = (
        Window.partitionBy("part")
        .orderBy(F.desc("at"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per range, so always small enough for one task and to broadcast.
    later_parts = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        times.groupBy("part")
        .agg(F.min("end_at").alias("first_end"))
        .select("part", F.min("first_end").over(later_parts).alias("carried"))
    )
    return (
        times.withColumn("here", F.min("end_at").over(later_here))
        .filter("starts")
        .join(F.broadcast(carried), "part")
        .select(
            F.col("at").alias("start_time"), F.coalesce("here", "carried").alias("end_time")
        )
        .filter(F.col("end_time").isNotNull())
    )
