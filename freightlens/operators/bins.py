"""Bins with fixed cut points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_column(value: Column, below: Sequence[float], labels: Sequence[str]) -> Column:
    """Label a value by the first cut point it lies below.

    The last label takes everything else, including NULL.
    """
    if len(labels) != len(below) + 1:
        raise ValueError("need one label more than cut points")
    binned = F.lit(labels[-1])
    for cut, label in reversed(list(zip(below, labels))):
        binned = F.when(value < cut, label).otherwise(binned)
    return binned


def label_rank(label: Column, labels: Sequence[str]) -> Column:
    """Position of a label in its list, for ordering bins by meaning."""
    return F.array_position(F.array(*(F.lit(text) for text in labels)), label)
