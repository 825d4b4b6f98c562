"""Grouped summaries. Every group collapses on the map side before it shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions import round_half_up, share
from freightlens.operators.exact import Mean, Rows, exact_aggregate, mean


def group_profile(
    df: DataFrame,
    keys: Mapping[str, Column],
    measures: Mapping[str, Column] | Mapping[str, Mean | Rows],
    digits: Mapping[str, int] | None = None,
) -> DataFrame:
    """Aggregate ``measures`` per ``keys`` and round the ones named in ``digits``.

    Measures are either all aggregate columns or all exact measures.
    """
    digits = digits or {}
    if any(isinstance(m, (Mean, Rows)) for m in measures.values()):
        return rounded_each(exact_aggregate(df, keys, measures), digits)
    found = df.groupBy(*(key.alias(name) for name, key in keys.items())).agg(
        *(agg.alias(name) for name, agg in measures.items())
    )
    return rounded_each(found, digits)


def rounded_each(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Round the named columns to the given digits each."""
    return df.withColumns({c: round_half_up(F.col(c), n) for c, n in digits.items()})


def cross_profile(
    df: DataFrame,
    few: tuple[str, Column],
    other: tuple[str, Column],
    value: str,
    names: tuple[str, str],
    digits: int = 4,
) -> DataFrame:
    """Mean of ``value`` per ``few`` key beside its mean per ``other`` key, all combinations.

    ``few`` must have a small fixed domain (hours of the day): its means travel
    as one short array and unfold next to each ``other`` row. Both roll-ups
    start from the same per-cell sums, so the fact is scanned once. The result
    has |few| x |other| rows by definition.
    """
    few_name, few_key = few
    other_name, other_key = other
    few_mean, other_mean = names
    cells = df.groupBy(few_key.alias(few_name), other_key.alias(other_name)).agg(
        F.sum(value).alias("total"), F.count(value).alias("n")
    )
    average = round_half_up(F.try_divide(F.sum("total"), F.sum("n")), digits)
    few_means = cells.groupBy(few_name).agg(average.alias(few_mean))
    beside = few_means.agg(F.collect_list(F.struct(few_name, few_mean)))
    return (
        cells.groupBy(other_name)
        .agg(average.alias(other_mean))
        .select(other_name, other_mean, F.inline(beside.scalar()))
        .select(few_name, few_mean, other_name, other_mean)
    )


def period_union(
    df: DataFrame,
    periods: Mapping[str, Column],
    value: str,
    suffix: str,
    digits: int = 2,
) -> DataFrame:
    """Mean, minimum and maximum of ``value`` per period, one block of rows per period type.

    The fact collapses once to one row per combination of periods; grouping sets
    then expand only those rows. Period values are text, so blocks of different
    types stack.
    """
    names = list(periods)
    cells = df.groupBy(*(key.alias(name) for name, key in periods.items())).agg(
        F.sum(value).alias("total"),
        F.count(value).alias("n"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )
    sets = cells.groupingSets([[name] for name in names], *names).agg(
        *(F.grouping(name).alias(f"_without_{name}") for name in names),
        F.try_divide(F.sum("total"), F.sum("n")).alias("mean"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )

    def pick(result: Mapping[str, Column]) -> Column:
        return F.coalesce(
            *(F.when(F.col(f"_without_{n}") == 0, result[n]) for n in names)
        )

    return sets.select(
        pick({n: F.lit(n) for n in names}).alias("period_type"),
        pick({n: F.col(n).cast("string") for n in names}).alias("period_value"),
        round_half_up(F.col("mean"), digits).alias(f"avg_{suffix}"),
        round_half_up(F.col("low"), digits).alias(f"min_{suffix}"),
        round_half_up(F.col("high"), digits).alias(f"max_{suffix}"),
    )


def share_where(df: DataFrame, condition: Column, name: str, digits: int = 2) -> DataFrame:
    """Percentage of all rows that meet the condition; NULL for an empty input."""
    return df.agg(round_half_up(share(condition) * 100, digits).alias(name))


def mean_of_period_means(
    df: DataFrame,
    period: Column,
    key: str,
    measures: Mapping[str, tuple[str, int]],
) -> DataFrame:
    """Average per ``key`` of the per-period averages.

    ``measures`` maps an output name to its source column and rounding.
    """
    of_key = {key: F.col(key)}
    per_period = exact_aggregate(
        df, {**of_key, "_period": period}, {name: mean(source) for name, (source, _) in measures.items()}
    )
    overall = exact_aggregate(per_period, of_key, {name: mean(name) for name in measures})
    return rounded_each(overall, {name: digits for name, (_, digits) in measures.items()})
