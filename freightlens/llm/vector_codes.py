"""Vector codes: each part of a vector becomes the index of the nearest entry of a codebook.

Vectors are made integer by floor(scale * x) and cut into equal consecutive parts. Each
part position has a codebook, which starts as that part of the vectors of least id and is
then refined: every part goes to its nearest entry, and each entry becomes the floored
mean of its parts. All numbers are integers, so nothing depends on the order of rows.

The nearest entry is found by equal-average search. Entries are sorted by the sum of
their components. A part and an entry whose sums differ by g are, in d dimensions, at
least g * g / d apart (squared). So the search starts at the part's own sum and moves
outward on both sides, on each until g * g / d strictly exceeds the best distance so far;
only strictly, so that an equally near entry of a lower index is still met. The parts of
a batch move together in numpy and leave the search one by one.

A round is one pass over the vectors: a task sends one row of sums for each component of
the entries it used, and the new codebooks, parts * entries short arrays, travel in the next
round's closure. Vectors are never shuffled.

Defined cases: vectors that are null, or hold a null or non-finite component, are dropped;
so are those whose length is not a positive multiple of ``parts``, or not that of the kept
vector of least id. Null ids come last when the first entries are chosen; rows of equal id
count each, in the order of their vectors. With fewer rows than entries the codebooks are
smaller. Only the columns named are read. Components and errors must fit in 64 bits;
where squares might not, the search uses Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from freightlens.llm.common import slices
from freightlens.llm.topk import integer_vector

#: Vectors that a task codes at a time.
ROWS = 4096
#: With dimensions times the largest component below this, all squares fit in 64 bits.
_SAFE = 1 << 30

#: One array of (entries, components) for each part.
Codebooks = list[np.ndarray]


def _largest(numbers: np.ndarray) -> int:
    return max(int(numbers.max(initial=0)), -int(numbers.min(initial=0)))


def nearest_entries(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry to each row, ties to the lower index, and its squared distance."""
    dim = rows.shape[1]
    safe = dim * max(_largest(rows), _largest(entries)) < _SAFE
    rows, entries = (x.astype(np.int64 if safe else object) for x in (rows, entries))
    sums = entries.sum(axis=1)
    order = np.array(sorted(range(len(sums)), key=lambda i: (sums[i], i)), np.int64)
    sums, entries = sums[order], entries[order]
    own = rows.sum(axis=1)
    found = np.full(len(rows), len(order), np.int64)
    best = np.full(len(rows), np.iinfo(np.int64).max // dim, rows.dtype)
    if not safe:
        best[:] = 4 * dim * max(_largest(rows), _largest(entries)) ** 2 + 1

    right = np.searchsorted(sums, own)
    every = np.arange(len(rows))
    sides = [(every, right, 1), (every, right - 1, -1)]
    while sides:
        going = []
        for active, place, step in sides:
            there = (place >= 0) & (place < len(sums))
            active, place = active[there], place[there]
            gap = own[active] - sums[place]
            close = (gap * gap <= best[active] * dim).astype(bool)
            active, place = active[close], place[close]
            apart = rows[active] - entries[place]
            distance, index = (apart * apart).sum(axis=1), order[place]
            nearer = distance < best[active]
            nearer |= (distance == best[active]) & (index < found[active])
            nearer = nearer.astype(bool)
            best[active[nearer]], found[active[nearer]] = distance[nearer], index[nearer]
            if active.size:
                going.append((active, place + step, step))
        sides = going
    return found, best


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with the vectors of their first column."""
    for batch in slices(batches, ROWS):
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        yield batch, flat.astype(np.int64).reshape(-1, dim)


def usable_vectors(
    df: DataFrame, vec_id: str, vector: str, parts: int, scale: int, keep: Sequence[str] = ()
) -> DataFrame:
    """(v, id, kept columns) of the rows whose vector can be cut; v is the integer vector."""
    whole = integer_vector(F.col(f"`{vector}`"), scale)
    rows = df.select(whole.alias("__v"), *(F.col(f"`{c}`") for c in (vec_id, *keep)))
    return rows.where(F.col("__v").isNotNull() & (F.size("__v") % parts == 0))


def fit_codebooks(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> Codebooks:
    """The codebooks after ``rounds``; empty ones for a table without usable vectors.

    Runs a job for the first entries (two if vectors differ in length) and one for each
    round. What a job returns is as large as the codebooks at most.
    """
    rows = usable_vectors(df, vec_id, vector, parts, scale)

    def least() -> list[list[int]]:
        by_id = rows.orderBy(F.col(f"`{vec_id}`").asc_nulls_last(), "__v")
        return [r["__v"] for r in by_id.select("__v").limit(entries).collect()]

    first = least()
    if not first:
        return [np.empty((0, 0), np.int64) for _ in range(parts)]
    rows = rows.where(F.size("__v") == len(first[0]))
    if any(len(v) != len(first[0]) for v in first):
        first = least()
    books = np.split(np.array(first, np.int64), parts, axis=1)
    for _ in range(rounds):
        books = _refined(rows, books)
    return books


def _refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floored mean of its parts; unused entries stay."""
    count, dim = books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.zeros((len(books), count), np.int64)
        sums = np.zeros((len(books), count, dim), np.int64)
        for _, vectors in _matrices(batches, dim * len(books)):
            for at, part in enumerate(np.split(vectors, len(books), axis=1)):
                index, _ = nearest_entries(part, books[at])
                used[at] += np.bincount(index, minlength=count)
                np.add.at(sums[at], index, part)
        part, entry = np.nonzero(used)
        columns = [
            np.repeat(part, dim),
            np.repeat(entry, dim),
            np.tile(np.arange(dim), part.size),
            np.repeat(used[part, entry], dim),
            sums[part, entry].reshape(-1),
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int64)) for c in columns],
            names=["part", "entry", "place", "used", "total"],
        )

    partial = rows.select("__v").mapInArrow(
        run, "part long, entry long, place long, used long, total long"
    )
    totals = partial.groupBy("part", "entry", "place").agg(
        F.sum("used").alias("used"), F.sum("total").alias("total")
    )
    new = [book.copy() for book in books]
    for r in totals.collect():  # parts * entries * dim rows at most
        new[r["part"]][r["entry"], r["place"]] = r["total"] // r["used"]
    return new


def encode_vectors(
    df: DataFrame,
    books: Codebooks,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, kept columns, code, error) of each usable vector.

    ``code`` has one byte for each part, so there are 256 entries at most; ``error`` is the
    sum of the squared distances. Both take the place of kept columns of that name. No shuffle.
    """
    count, dim = books[0].shape
    if count > 256:
        raise ValueError("a byte names at most 256 entries")
    keep = [c for c in keep if c.lower() not in ("code", "error")]
    rows = usable_vectors(df, vec_id, vector, len(books), scale, keep)
    rows = rows.where(F.size("__v") == dim * len(books))
    own = [rows.schema[c] for c in rows.columns if c != "__v"]
    schema = StructType([*own, StructField("code", BinaryType()), StructField("error", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, vectors in _matrices(batches, dim * len(books)):
            codes = np.empty((len(vectors), len(books)), np.uint8)
            errors = 0
            for at, part in enumerate(np.split(vectors, len(books), axis=1)):
                codes[:, at], apart = nearest_entries(part, books[at])
                errors = errors + apart
            made = [
                pa.array([row.tobytes() for row in codes], pa.binary()),
                pa.array(errors.tolist(), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *made], names=[f.name for f in schema]
            )

    return rows.mapInArrow(run, schema)


def codebook_text(books: Codebooks) -> str:
    """All components in decimal, by part, entry and place, comma-joined."""
    return ",".join(str(x) for book in books for x in book.reshape(-1).tolist())
