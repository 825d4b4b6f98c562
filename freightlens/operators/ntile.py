"""Exact NTILE over a whole table without moving the table to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.operators.row_search import literals, rows_at_ranks


def exact_ntile(df: DataFrame, name: str, tiles: int, key: str, tie_break: str) -> DataFrame:
    """Add the NTILE number of each row in (key, tie_break) order, NULL keys first.

    ``tie_break`` must be unique. The table itself is not shuffled: a tile number follows
    from comparing a row with the last row of each earlier tile, and only those
    ``tiles - 1`` rows are searched for. The search runs when this is called and
    reads the input several times, so pass a stored table rather than an expensive join.
    """
    order = [key, tie_break]

    def ends(count: int) -> dict[str, int]:
        """The rank of the last row of each tile but the last."""
        size, more = divmod(count, tiles)
        return {str(t): min(size * t + min(more, t), count) for t in range(1, tiles)}

    cuts = list(dict.fromkeys(rows_at_ranks(df, order, ends).values())) if tiles > 1 else []
    row = F.struct(*(F.col(c) for c in order))
    tile = F.lit(len(cuts) + 1)
    for number, cut in reversed(list(enumerate(cuts, start=1))):
        tile = F.when(row <= literals(df, order, cut), number).otherwise(tile)
    return df.withColumn(name, tile)
