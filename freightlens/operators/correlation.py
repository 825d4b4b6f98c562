"""Correlation reports, each from a single one-row aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.functions import pearson_centred, pearson_moments, round_half_up


def pearson_wide(
    df: DataFrame, pairs: Mapping[str, tuple[str, str]], digits: int = 4
) -> DataFrame:
    """One column of r per named pair."""
    return df.agg(
        *(
            round_half_up(pearson_moments(F.col(x), F.col(y)), digits).alias(name)
            for name, (x, y) in pairs.items()
        )
    )


def pearson_ranked(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features against the target, strongest absolute correlation first."""
    wide = df.agg(
        *(pearson_moments(F.col(f), F.col(target)).alias(f) for f in features)
    )
    return wide.unpivot([], list(features), "feature", "corr_value").orderBy(
        F.abs("corr_value").desc(), "feature"
    )


def lead_corr(
    df: DataFrame, period: Column, x: Column, y: Column, digits: int = 4
) -> DataFrame:
    """Correlate per-period means: same period, and next period's x with this period's y.

    The fact collapses to one row per calendar period first, so the window over
    all periods is bounded by the calendar.
    """
    per_period = df.groupBy(period.alias("period")).agg(
        F.avg(x).alias("x"), F.avg(y).alias("y")
    )
    shifted = per_period.withColumn(
        "x_next", F.lead("x").over(Window.orderBy("period"))
    )
    y_mean = F.col("y")
    return shifted.agg(
        round_half_up(pearson_centred(F.col("x"), y_mean), digits).alias("corr_same_day"),
        round_half_up(pearson_centred(F.col("x_next"), y_mean), digits).alias(
            "corr_lag1_day"
        ),
    )
