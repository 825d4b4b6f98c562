"""Rounding and ratios that behave the same under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """Round the decimal text of a double half up, once; NaN and infinities stay."""
    return F.round(value.cast("double"), digits)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round the named columns, keeping column order."""
    return df.withColumns({c: round_half_up(F.col(c), digits) for c in columns})


def share(condition: Column) -> Column:
    """Fraction of rows where the condition holds; NULL counts as not holding."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))
