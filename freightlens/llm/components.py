"""Connected components of an edge table by repeated star contraction.

Each round ties every node and its neighbours to the least of them, which keeps what is
connected and shortens paths until every component is a star around its least node.
Nothing is collected: a round is a grouped minimum, a join and a distinct, and its edges
are stored in the shared folder, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.sources import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "m"))).first()
    return tuple(row)


def _contracted(edges: DataFrame) -> DataFrame:
    ends = F.explode(
        F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("w")),
            F.struct(F.col("m").alias("u"), F.col("v").alias("w")),
        )
    )
    both = edges.select(ends.alias("e")).select("e.u", "e.w")
    least = both.groupBy("u").agg(F.min("w").alias("least"))
    # a hot node's rows are many on one side only, which a skewed join splits; the other
    # side is stored, as an aggregate would not leave the join's stage
    least = stored(least.select("u", F.least("u", "least").alias("least")), "least")
    tied = both.join(least, "u").select(
        F.explode(F.array("u", "w")).alias("v"), F.col("least").alias("m")
    )
    return tied.where("v != m").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that is not its component's least, which is the root.

    Null ends and loops are ignored; repeated edges count once. Runs jobs when called.
    """
    current = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("v"), F.least(a, b).alias("m")
    )
    current = stored(current.distinct(), "edges")
    state = _state(current)
    while state[0]:
        current = stored(_contracted(current), "edges")
        before, state = state, _state(current)
        if state == before:
            break
    return current.select(F.col("v").alias("node"), F.col("m").alias("root"))
