"""Blocked Bloom filters as DataFrames.

A filter has 256-bit blocks of eight 32-bit words. A key's hash names its block and one
bit in each word, so a look-up is one join with the broadcast blocks. The number of
blocks follows the number of keys up to ``max_blocks``, the bound of the broadcast; beyond
it the filter passes more keys that it does not hold, never fewer that it does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.common import without

WORDS = 8
#: Bits of the filter for each key: about 1 in 1000 others passes.
BITS_PER_KEY = 16
#: 2**18 blocks are 8 MB of bits.
MAX_BLOCKS = 1 << 18


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """The bit of each word that a key sets: five bits of a second hash for each word."""
    code = F.xxhash64(F.lit("bits"), key)
    one = F.lit(1).cast("long")
    shifts = [F.shiftrightunsigned(code, 5 * k).bitwiseAND(31).cast("int") for k in range(WORDS)]
    return [F.call_function("shiftleft", one, s) for s in shifts]


def block_count(keys: int, max_blocks: int = MAX_BLOCKS) -> int:
    return min(max_blocks, max(1, -(-keys * BITS_PER_KEY // 256)))


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter: a row for each block that holds a key, with its words w0 to w7."""
    masked = keys.select(
        _block(F.col(key), blocks).alias("block"),
        *(m.alias(f"w{k}") for k, m in enumerate(_masks(F.col(key)))),
    )
    return masked.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))


def with_possible(
    df: DataFrame, key: str, keys: DataFrame, keys_key: str, blocks: int, column: str = "__maybe"
) -> DataFrame:
    """The frame with whether the filter passes its key; false for a null key."""
    base = without(df, column)
    held = F.broadcast(bloom_blocks(keys, keys_key, blocks).withColumnRenamed("block", "__block"))
    bits = [F.col(f"w{k}").bitwiseAND(m) == m for k, m in enumerate(_masks(F.col(key)))]
    passes = F.coalesce(reduce(lambda a, b: a & b, bits), F.lit(False)) & F.col(key).isNotNull()
    joined = base.withColumn("__block", _block(F.col(key), blocks)).join(held, "__block", "left")
    return joined.withColumn(column, passes).select(*(F.col(f"`{c}`") for c in base.columns), column)
