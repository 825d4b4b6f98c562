"""Sharding by rendezvous hashing of record keys over weighted shards.

For every shard a hash of (key, shard) gives a uniform number u; the record goes to the
shard with the least -ln(u) / weight. Shards win in proportion to their weights, and a
shard that is added or removed moves only the records it wins or held.

Slots number a shard's records without gaps. A shard is far too large for one task, so
records are dealt into buckets of a shard by a hash of their columns; equal records are
counted first, so that a record repeated any number of times is one row until the end.
Numbers inside a bucket plus the sizes of the buckets before it give the slots.

Defined cases: a null key is a key like any other; records with equal keys share a
shard; an empty table gives an empty result. Slots follow (bucket, sort columns), so the
same rows get the same set of slots however they are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.llm.common import without

#: Buckets of each shard. Fixed, so that the table of their sizes is bounded.
BUCKETS = 1024
#: Copies of one record that one row stands for; more are dealt into several rows.
CHUNK = 10_000


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard, 0 to len(weights) - 1, for a key; weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    costs = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
        uniform = (bits + 0.5) / float(1 << 53)
        costs.append(F.struct((-F.log(uniform) / float(weight)).alias("c"), F.lit(shard).alias("s")))
    return F.array_min(F.array(*costs))["s"] if len(costs) > 1 else F.lit(0)


def with_shards(
    df: DataFrame, key: str, weights: Sequence[float], column: str = "shard"
) -> DataFrame:
    """The frame with each record's shard; no shuffle."""
    return without(df, column).withColumn(column, rendezvous_shard(F.col(key), weights))


def with_slots(
    df: DataFrame, shard: str = "shard", column: str = "slot", buckets: int = BUCKETS
) -> DataFrame:
    """The frame with a number for each record inside its shard, gapless from 0.

    All columns must be groupable; they decide the order. Carry only what the numbering
    needs, keys and sizes say, and join texts by key afterwards.
    """
    base = without(df, column)
    names = [f"`{c}`" for c in base.columns]
    counted = base.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn(
        "__bucket", F.pmod(F.xxhash64(*(F.col(c) for c in names)), F.lit(buckets))
    )
    order = Window.partitionBy(f"`{shard}`", "__bucket").orderBy(*names)
    placed = counted.withColumn(
        "__first", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    sizes = counted.groupBy(F.col(f"`{shard}`").alias("__shard"), "__bucket").agg(
        F.sum("__n").alias("__size")
    )
    before = Window.partitionBy("__shard").orderBy("__bucket")
    offsets = sizes.select(
        "__shard",
        F.col("__bucket").alias("__b"),
        F.coalesce(
            F.sum("__size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__offset"),
    )
    joined = placed.join(
        F.broadcast(offsets),
        F.col(f"`{shard}`").eqNullSafe(F.col("__shard")) & (F.col("__bucket") == F.col("__b")),
    )
    start = F.col("__offset") + F.coalesce("__first", F.lit(0))
    chunks = joined.select(
        *names,
        start.alias("__start"),
        F.col("__n"),
        F.explode(F.expr(f"sequence(0L, __n - 1, {CHUNK}L)")).alias("__chunk"),
    )
    last = F.least(F.col("__n"), F.col("__chunk") + CHUNK) - 1
    return chunks.select(
        *names,
        (F.explode(F.sequence(F.col("__start") + F.col("__chunk"), F.col("__start") + last))).alias(
            column
        ),
    )
