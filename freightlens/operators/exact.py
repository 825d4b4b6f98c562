"""Grouped means of doubles whose sums are exact."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions.exact_sum import (
    DIGITS,
    exact_total,
    exponent_bin,
    finite,
    unit_digits,
    units,
)


@dataclass(frozen=True)
class Mean:
    """Mean of a column's values that are not NULL."""

    of: Column


@dataclass(frozen=True)
class Rows:
    """Number of rows."""


def mean(column: Column | str) -> Mean:
    return Mean(F.col(column) if isinstance(column, str) else column)


def share(condition: Column) -> Mean:
    """Fraction of rows where the condition holds; NULL counts as not holding."""
    return Mean(F.when(condition, 1.0).otherwise(0.0))


def exact_aggregate(
    df: DataFrame, keys: Mapping[str, Column], measures: Mapping[str, Mean | Rows]
) -> DataFrame:
    """Group by ``keys`` and compute the measures.

    A mean is the exact sum of the values, rounded once, over their number, so it is the
    same under any partitioning and for values of any magnitude. NaN and infinities give
    what plain addition gives.

    Rows collapse to one row for each group and combination of the values' bins, which the
    map side does already; a value's bin changes with every 20 bits of magnitude, so a group
    has few. The few rows of a group are then put together. Without keys there is one row, also
    for an empty input.
    """
    means = {f"m{k}": m.of.cast("double") for k, m in enumerate(measures.values()) if isinstance(m, Mean)}
    own = [f"k{k}" for k in range(len(keys))]
    rows = (
        df.select(*(key.alias(k) for k, key in zip(own, keys.values())), *(v.alias(m) for m, v in means.items()))
        .selectExpr("*", *(f"{finite(m)} AS {m}_finite" for m in means))
        .selectExpr("*", *(f"{exponent_bin(f'{m}_finite')} AS {m}_bin" for m in means))
        .selectExpr("*", *(f"{units(f'{m}_finite', f'{m}_bin')} AS {m}_units" for m in means))
    )
    partial = ["count(1) AS n"]
    merged = ["coalesce(sum(n), 0L) AS n"]
    for m in means:
        digits = [f"sum({digit})" for digit in unit_digits(f"{m}_units")]
        entry = f"named_struct('bin', {m}_bin, 'digits', {m}_digits)"
        partial += [
            f"count({m}) AS {m}_n",
            f"sum(IF({m}_finite IS NULL, {m}, NULL)) AS {m}_odd",
            f"array({', '.join(digits)}) AS {m}_digits",
        ]
        merged += [
            f"sum({m}_n) AS {m}_n",
            f"sum({m}_odd) AS {m}_odd",
            f"collect_list(IF({m}_bin IS NOT NULL, {entry}, NULL)) AS {m}",
        ]
    cells = rows.groupBy(*own, *(f"{m}_bin" for m in means)).agg(*map(F.expr, partial))
    groups = cells.groupBy(*own).agg(*map(F.expr, merged))

    def result(at: int, name: str) -> Column:
        m = f"m{at}"
        if m not in means:
            return F.col("n").alias(name)
        return F.expr(f"try_divide(coalesce({m}_odd, {exact_total(m)}), {m}_n)").alias(name)

    return groups.select(
        *(F.col(k).alias(name) for k, name in zip(own, keys)),
        *(result(at, name) for at, name in enumerate(measures)),
    )


def exact_deviation(df: DataFrame, value: str) -> tuple[Column, Column]:
    """Mean and population standard deviation of a column, as scalars.

    Two readings: the exact mean, then the exact mean of the squared distances from it. Each
    square is rounded for its own row only, so the result does not depend on the order of
    rows either, and nothing cancels where the mean is large.
    """
    average = exact_aggregate(df, {}, {"m": mean(value)}).scalar()
    apart = df.select((F.col(value) - average).alias("d"))
    variance = exact_aggregate(apart, {}, {"v": mean(F.col("d") * F.col("d"))})
    return average, F.sqrt(variance.scalar())
