"""Series of one row per period. Offsets count rows, not calendar days.

Inputs are grouped by calendar period first. A window over all periods
therefore holds as many rows as there are days or months, whatever the size of
the fact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.functions import round_half_up


def lag_features(
    series: DataFrame, entity: str, period: str, lags: Mapping[str, str], offset: int = 1
) -> DataFrame:
    """Add earlier values per entity and drop rows that lack any of them.

    ``lags`` maps a new column to its source column.
    """
    order = Window.partitionBy(entity).orderBy(period)
    return series.withColumns(
        {name: F.lag(source, offset).over(order) for name, source in lags.items()}
    ).dropna(subset=list(lags))


def seasonal_forecast(
    df: DataFrame,
    at: Column,
    demand: str,
    last_week: int = 7,
    last_year: int = 365,
    rows: int = 30,
) -> DataFrame:
    """Daily totals with a blend of weekday mean and two lags, latest days first.

    The weekday mean covers all days, later ones included, and the blend uses
    the row's own weekday; it is NULL until both lags exist. The overall mean is
    reported but not blended.
    """
    daily = df.groupBy(at.alias("dt")).agg(F.sum(demand).alias("total_demand"))
    order = Window.orderBy("dt")
    total = F.col("total_demand")
    stats = daily.withColumns(
        {
            "weekday_mean": F.avg(total).over(Window.partitionBy(F.dayofweek("dt"))),
            "overall_mean": F.avg(total).over(Window.partitionBy()),
            "demand_last_week": F.lag(total, last_week).over(order),
            "demand_last_year": F.lag(total, last_year).over(order),
        }
    )
    blend = (
        F.col("weekday_mean") + F.col("demand_last_week") + F.col("demand_last_year")
    ) / 3
    return (
        stats.select(
            "dt",
            "total_demand",
            round_half_up(F.col("weekday_mean"), 2).alias("avg_weekday_demand"),
            round_half_up(F.col("overall_mean"), 2).alias("avg_daily_demand"),
            "demand_last_week",
            "demand_last_year",
            round_half_up(blend, 2).alias("forecast_for_next_day"),
        )
        .orderBy(F.desc("dt"))
        .limit(rows)
    )


def rolling_rows_mean(
    series: DataFrame, order_by: Sequence[str], value: str, name: str, rows: int, digits: int
) -> DataFrame:
    """Mean over the current and up to ``rows - 1`` earlier rows of a period series."""
    frame = Window.orderBy(*order_by).rowsBetween(1 - rows, Window.currentRow)
    return series.withColumn(name, round_half_up(F.avg(value).over(frame), digits))
