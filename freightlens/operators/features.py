"""Feature table assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame


def feature_set(df: DataFrame, columns: Sequence[str], derived: Mapping[str, Column]) -> DataFrame:
    """Project features in the given order; names found in ``derived`` are computed.

    No row is dropped.
    """
    return df.select(
        *(derived[name].alias(name) if name in derived else df[name] for name in columns)
    )
