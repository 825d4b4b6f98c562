"""Pearson correlation as one aggregate expression.

The three variants differ only in which rows each term sees when values are
missing; without NULLs they agree. All return NULL for zero variance.
They combine built-in covariance and deviation aggregates, which stay accurate
where differences of raw product sums would cancel. Variance counts as zero if the
least and the largest value are the same, whatever the computed deviation is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _varied(r: Column, *columns: Column) -> Column:
    """r, or NULL if a column has a single value: computed deviations need not be 0 then."""
    single = [F.min(c) == F.max(c) for c in columns]
    return F.when(~F.coalesce(F.greatest(*single), F.lit(True)), r)


def _paired(x: Column, y: Column) -> tuple[Column, Column]:
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def pearson_moments(x: Column, y: Column) -> Column:
    """E[xy] - E[x]E[y] over the two deviations, each term over its own non-NULL rows.

    With NULLs on one side only, the result may leave [-1, 1].
    """
    xp, yp = _paired(x, y)
    mean_product = F.covar_pop(x, y) + F.avg(xp) * F.avg(yp)
    r = F.try_divide(mean_product - F.avg(x) * F.avg(y), F.stddev_pop(x) * F.stddev_pop(y))
    return _varied(r, x, y)


def pearson_centred(x: Column, y: Column) -> Column:
    """Sum of products over root of the sums of squares, around each column's own mean.

    The product sum covers rows with both values; each square sum covers every
    row where that column is present.
    """
    xp, yp = _paired(x, y)
    products = F.count(xp + yp) * (
        F.covar_pop(x, y) + (F.avg(xp) - F.avg(x)) * (F.avg(yp) - F.avg(y))
    )
    squares = F.count(x) * F.var_pop(x) * F.count(y) * F.var_pop(y)
    return _varied(F.try_divide(products, F.sqrt(squares)), x, y)


def pearson_pairwise(x: Column, y: Column) -> Column:
    """Textbook r over the rows where both values are present."""
    xp, yp = _paired(x, y)
    return _varied(F.try_divide(F.covar_pop(x, y), F.stddev_pop(xp) * F.stddev_pop(yp)), xp, yp)
