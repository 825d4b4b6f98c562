"""Joins on keys that may hold a large part of all rows.

A shuffle brings all rows of a key to one task, and adaptive execution cannot split that task
where the other side is an aggregate on the same key, as it never left the join's stage.
Here the few keys that would overfill a task are looked for first; their rows are dealt
over several pieces of the key, and the other side's row is copied to each piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# Rows sampled for each shuffle partition, and the part of a partition that a hot key fills.
SAMPLE, HOT = 400, 0.25


def hot_keys(df: DataFrame, key: str) -> list[Row]:
    """(key, pieces) of the keys whose rows would fill a quarter of an even partition or more.

    Runs two jobs when called: a count, and the counts of a sample of the key column. No
    more keys are returned than four times the shuffle partitions, NULL among them. The
    sample only decides how rows are dealt.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.count()
    if not rows:
        return []
    share = min(1.0, SAMPLE * partitions / rows)
    fill = max(rows * share / partitions, 1.0)  # sampled rows of an even partition
    drawn = df.select(F.col(key).alias("key")).where(F.rand(7) < share)
    counted = drawn.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    pieces = F.ceil(F.col("n") / (HOT * fill)).cast("int")
    return counted.where(F.col("n") > HOT * fill).select("key", pieces.alias("pieces")).collect()


def is_broadcast(df: DataFrame) -> bool:
    """Whether Spark, by its own estimate and the session's threshold, would broadcast this side."""
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= threshold


def spread_join(
    detail: DataFrame,
    other: DataFrame,
    key: str,
    other_key: str,
    hot: Sequence[Row],
    spread_by: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Join ``detail`` with ``other`` on key = other_key; rows of ``hot`` keys spread over pieces.

    ``spread_by`` are columns of ``detail`` that differ between rows of a key; their hash
    decides the piece, so a task that is run again deals its rows alike. ``how`` is a join
    that keeps rows of the left side only: left, inner, left_semi or left_anti.
    """
    if not hot:
        return detail.join(other, F.col(key) == F.col(other_key), how)
    kind = detail.schema[key].dataType.simpleString()
    # a bounded number of rows, see hot_keys
    marked = F.broadcast(
        detail.sparkSession.createDataFrame([tuple(r) for r in hot], f"_hot {kind}, _pieces int")
    )
    dealt = detail.join(marked, F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn(
        "_piece", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_pieces")), F.lit(0)).cast("int")
    )
    last = F.coalesce(F.col("_pieces"), F.lit(1)) - 1
    copied = other.join(marked, F.col(other_key) == F.col("_hot"), "left").select(
        *other.columns, F.explode(F.sequence(F.lit(0), last)).alias("_copy")
    )
    same = (F.col(key) == F.col(other_key)) & (F.col("_piece") == F.col("_copy"))
    return dealt.join(copied, same, how).drop("_hot", "_pieces", "_piece", "_copy")
