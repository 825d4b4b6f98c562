"""Rank-based selection and numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightlens.operators.exact import Rows, exact_aggregate
from freightlens.operators.exact import mean as average
from freightlens.operators.profiles import rounded_each
from freightlens.sources.scratch import stored


def top_ranked(df: DataFrame, order_by: Sequence[str], k: int, name: str) -> DataFrame:
    """Rows with RANK <= k, ties kept.

    Spark limits each partition to its own best ranks before the single-task
    rank, so only candidates for the top k meet there.
    """
    ranked = df.withColumn(name, F.rank().over(Window.orderBy(*order_by)))
    return ranked.filter(F.col(name) <= k).orderBy(name)


def capacity_windows(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    tie_break: str,
    capacity: int,
    window: str,
    count: str,
    mean: str,
    digits: int = 2,
) -> DataFrame:
    """Cut each group, largest value first, into windows of ``capacity`` rows and profile them.

    Rows are sorted by ranges of (group, value, tie_break), so a large group
    covers many tasks. A row's number in its group is its place among the group's
    rows in its range, plus the group's rows in earlier ranges. Those come from one
    row per range and group, so detail meets them by (range, group) and a large
    group is never gathered. Stores the sorted rows when called.
    """
    order = [*(F.asc(g) for g in groups), F.desc(value), F.asc(tie_break)]
    rows = stored(
        df.select(*groups, value, tie_break)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        # partition number in the high bits, row position in the low 33 bits
        .select(*groups, value, F.monotonically_increasing_id().alias("id"))
        .withColumns(
            {
                "part": F.shiftright("id", 33),
                "offset": F.col("id").bitwiseAND(F.lit((1 << 33) - 1)),
            }
        )
        .drop("id"),
        "ordered-rows",
    )

    own = [f"_{g}" for g in groups]
    earlier = (
        Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    # one row per range and group: a range's rows of a group follow each other
    starts = (
        rows.groupBy(*(F.col(g).alias(f"_{g}") for g in groups), F.col("part").alias("_part"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min("offset").alias("first"))
        .withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        .drop("rows")
    )
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    place = F.col("before") + F.col("offset") - F.col("first")
    number = F.floor(place / capacity) + 1
    numbered = rows.join(starts, [*same, F.col("part") == F.col("_part")])
    keys = {g: F.col(g) for g in groups} | {window: number}
    found = exact_aggregate(numbered, keys, {count: Rows(), mean: average(value)})
    return rounded_each(found, {mean: digits}).orderBy(*groups, window)
