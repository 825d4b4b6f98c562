"""Rows that stand out against statistics of the whole table.

Each operator reads its input for the statistics and again for the rows; the statistics
come in as scalar subqueries, so nothing is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions import round_half_up
from freightlens.operators.exact import exact_aggregate, exact_deviation, mean
from freightlens.operators.order_stats import group_quantiles
from freightlens.operators.profiles import rounded_each


def iqr_outliers(df: DataFrame, value: str, factor: float = 1.5) -> DataFrame:
    """Rows above Q3 + factor x IQR, with that spread as column ``bound``.

    Only the upper side counts. Quartiles use the "ceil" rank rule.
    """
    quartiles = group_quantiles(df, value, {"q1": "0.25", "q3": "0.75"}, "ceil")
    spread = (F.col("q3") - F.col("q1")) * factor
    fence = quartiles.select(F.struct("q3", spread.alias("bound"))).scalar()
    return df.filter(F.col(value) > fence["q3"] + fence["bound"]).withColumn(
        "bound", fence["bound"]
    )


def sigma_limit(df: DataFrame, value: str, k: float) -> Column:
    """Mean plus k population standard deviations of a column, as a scalar.

    Both come from exact sums, so a row on the limit stays on its side under any partitioning.
    """
    average, deviation = exact_deviation(df, value)
    return average + k * deviation


def sigma_excursions(df: DataFrame, value: str, k: float = 3.0) -> DataFrame:
    """Rows whose value lies above mean + k sigma."""
    return df.filter(F.col(value) > sigma_limit(df, value, k))


def excursion_association(
    df: DataFrame,
    value: str,
    outcome: str,
    flags: Mapping[str, Column],
    excursion: str,
    names: str,
    k: float = 2.0,
    digits: int = 4,
) -> DataFrame:
    """Mean outcome with and without an excursion, split further by 0/1 flags."""
    above = F.when(F.col(value) > sigma_limit(df, value, k), 1).otherwise(0)
    marked = df.select(
        above.alias(excursion),
        *(F.when(flag, 1).otherwise(0).alias(name) for name, flag in flags.items()),
        F.col(outcome).alias("_outcome"),
    )
    keys = {key: F.col(key) for key in (excursion, *flags)}
    found = exact_aggregate(marked, keys, {names: mean("_outcome")})
    return rounded_each(found, {names: digits}).orderBy(*(F.desc(key) for key in keys))


def value_summary(
    df: DataFrame, value: str, prefix: str, digits: int = 2
) -> DataFrame:
    """Mean, population deviation and quartiles of one column in one row.

    Quartiles use the "floor" rank rule. An empty input gives no rows.
    """
    names: Sequence[str] = (f"{prefix}_q1", f"{prefix}_median", f"{prefix}_q3")
    quartiles = group_quantiles(df, value, dict(zip(names, ("0.25", "0.50", "0.75"))), "floor")
    average, deviation = exact_deviation(df, value)
    return quartiles.select(
        round_half_up(average, digits).alias(f"{prefix}_mean"),
        round_half_up(deviation, digits).alias(f"{prefix}_std"),
        *names,
    )
