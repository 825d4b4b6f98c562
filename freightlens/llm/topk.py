"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are made integer by floor(scale * x). The candidates are dealt into blocks, and a
block is sorted once in every dimension. For each query a task then reads
the lists in step from the end that the query's sign favours, scores every vector it
meets for the first time, and keeps the k best. No vector further down can score more
than the sum of the query's components times the current list values, so it stops when
the kth score beats that bound. The blocks' results are merged by a limited sort for
each query, so every exact result is found and no pair beyond k for a block is emitted.

Queries are sent in packets of at most ``PACKET`` vectors (a bound of what a task holds
besides its block); the packets of a block follow it in its task, so a block is sent once.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take
no part; only vectors of equal length are compared; a query never meets rows of its own
id; ties go to the smaller id; every row counts, so equal rows, and rows with an equal id
and other vectors, each take a rank of their own. Query rows of one id share its k ranks, each
bringing its own scores. Scores must fit in 64 bits. A query among fewer than k others
gets them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.sources import stored

#: Candidates in a block, and queries in a packet.
BLOCK, PACKET = 4096, 2048
#: Tasks that blocks are spread over: two for each block, so that few share one, at most these.
MAX_TASKS = 1 << 14
#: Integer sums below this are exact in a double.
_EXACT = float(1 << 53)


def integer_vector(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as double; null if any is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(
        doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    whole = F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return F.when(F.coalesce(sound, F.lit(False)) & (F.size(vector) > 0), whole)


class _Block:
    """A block of candidates and its sorted lists."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # so that ties take the smaller id
        self.ids, self.copies, vectors = ids[order], copies[order], vectors[order]
        self.largest = float(np.abs(vectors).max(initial=0))
        self.vectors = vectors
        self.doubles = vectors.astype(np.float64)
        self.lists = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.doubles, self.lists, axis=0)

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best for a query, best first."""
        used = np.flatnonzero(query)
        exact = self.largest * float(np.abs(query).sum()) < _EXACT
        weights = query.astype(np.float64)
        rows = self.ids.size
        if not used.size:
            places = np.flatnonzero(self.ids != own)[:k]
            return places, np.zeros(places.size, np.int64)
        up, down = used[query[used] > 0], used[query[used] < 0]
        seen = self.ids == own
        places, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step = 0, max(4, k // 4)
        while depth < rows:
            until = min(rows, depth + step)
            met = np.zeros(rows, bool)
            met[self.lists[rows - until : rows - depth, up]] = True
            met[self.lists[depth:until, down]] = True
            fresh = np.flatnonzero(met & ~seen)
            seen[fresh] = True
            if exact:
                found = np.rint(self.doubles[fresh] @ weights).astype(np.int64)
            else:
                found = self.vectors[fresh] @ query
            places, scores = np.concatenate([places, fresh]), np.concatenate([scores, found])
            best = np.lexsort((places, -scores))[:k]
            places, scores = places[best], scores[best]
            bound = float(
                self.values[rows - until, up] @ weights[up]
                + self.values[until - 1, down] @ weights[down]
            )
            # a bound that is not exact is raised, so that no tie is missed
            slack = 0.0 if exact else abs(bound) * 1e-9 + 1
            if seen.all() or scores.size == k and scores[-1] > bound + slack:
                break
            depth, step = until, step * 2
        return places, scores


def _packed(df: DataFrame, group: Column, name: str) -> DataFrame:
    """One row for each group of vectors: ids and components, both as bytes."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(part["v"].to_numpy()).astype("<i8")
        return pd.DataFrame(
            {
                "dim": [vectors.shape[1]],
                name: [int(part["group"].iloc[0])],
                "ids": [part["id"].to_numpy("<i8").tobytes()],
                "copies": [part["copies"].to_numpy("<i8").tobytes()],
                "vectors": [vectors.tobytes()],
            }
        )

    schema = f"dim int, {name} int, ids binary, copies binary, vectors binary"
    return (
        df.withColumn("group", group).groupBy("dim", "group").applyInPandas(run, schema)
    )


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 64,
    block: int = BLOCK,
    packet: int = PACKET,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best among the vectors.

    Both frames have an integer id and a vector. Counts and stores them when called.
    """

    def whole(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(
            F.col(f"`{vec_id}`").cast("long").alias("id"),
            integer_vector(F.col(f"`{vector}`"), scale).alias("v"),
        ).where("id is not null and v is not null")
        counted = rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))
        return stored(counted.withColumn("dim", F.size("v")), name)

    rows, asked = whole(vectors, "vectors"), whole(queries, "queries")
    blocks = max(1, -(-rows.count() // block))
    packets = max(1, -(-asked.count() // packet))
    dealt = F.xxhash64("id", "v")
    packed = stored(_packed(rows, F.pmod(dealt, F.lit(blocks)).cast("int"), "block"), "blocks")
    sent = stored(_packed(asked, F.pmod(dealt, F.lit(packets)).cast("int"), "packet"), "packets")
    # the block itself is packet -1 and comes first
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    columns = ["dim", "block", "packet", "ids", "copies", "vectors"]
    wanted = sent.select("*", every_block).select(*columns)
    held = packed.withColumn("packet", F.lit(-1)).select(*columns)
    met = (
        held.unionByName(wanted)
        .repartition(min(2 * blocks, MAX_TASKS), "dim", "block")
        .sortWithinPartitions("dim", "block", "packet")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = None, None
        for batch in batches:
            for row in batch.to_pylist():
                dim, at = row["dim"], (row["dim"], row["block"])
                ids, copies = (np.frombuffer(row[c], "<i8") for c in ("ids", "copies"))
                vectors = np.frombuffer(row["vectors"], "<i8").reshape(-1, dim)
                if row["packet"] < 0:
                    own, place = _Block(ids, copies, vectors), at
                    continue
                if place != at:
                    continue  # no candidate of this length in the block
                out: list[list[np.ndarray]] = [[], [], [], []]
                for query_id, times, query in zip(ids.tolist(), copies.tolist(), vectors, strict=True):
                    places, scores = own.top(query_id, query, k)
                    out[0].append(np.full(places.size, query_id))
                    out[1].append(own.ids[places])
                    out[2].append(scores)
                    out[3].append(np.minimum(own.copies[places] * times, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in out],
                    names=["query_id", "vec_id", "score", "copies"],
                )

    near = met.mapInArrow(search, "query_id long, vec_id long, score long, copies long")
    near = near.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
