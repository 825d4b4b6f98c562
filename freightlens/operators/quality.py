"""Completeness and variability of columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality_profile(df: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Row count, and per column the NULL percentage and CONSTANT / VARIED.

    ``columns`` maps a source column to its two output names. A column is
    constant if it has exactly one distinct non-NULL value, which its minimum
    and maximum tell without a distinct count; an all-NULL column is VARIED.
    """
    total = F.count(F.lit(1))
    report = [total.alias("total_rows")]
    for source, (null_name, variability_name) in columns.items():
        nulls = F.count_if(F.col(source).isNull())
        report.append(F.try_divide(nulls * 100, total).alias(null_name))
        report.append(
            F.when(F.min(source) == F.max(source), "CONSTANT")
            .otherwise("VARIED")
            .alias(variability_name)
        )
    return df.agg(*report)
