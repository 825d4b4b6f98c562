"""Packing by concatenate and cut.

All documents, each with an end id, are one long stream that is cut every ``length``
ids, so only the last sequence needs padding. The place of a document in the stream
comes from prefix sums in two passes. The first makes the ids and sums them up inside
each partition; its result is stored, as ids are dear to make twice and the stream's
order must not change. Sums of the partitions, one row each, give every partition's
offset. The second pass adds both and cuts; a document that lies across a cut becomes
several pieces, one for each sequence it touches.

Defined cases: a null text is an empty one, which is its end id alone; a null or
repeated id marks rows like any other; an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from freightlens.llm.common import fields_of, slices
from freightlens.llm.tokens import encoder
from freightlens.sources import stored


def tokenised(docs: DataFrame, doc_id: str, text: str, path: str, end: int) -> DataFrame:
    """First pass: id, part, first (ids before it in the part), doc_tokens, ids; stored.

    ``ids`` are little-endian integers, of 16 bits for vocabularies that fit.
    """
    narrow = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")
    )
    made = fields_of("part int, first long, doc_tokens long, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, total = encoder(path), TaskContext.get().partitionId(), 0
        last = np.array([end], own.dtype).tobytes()
        for batch in slices(batches):
            firsts, counts, ids = [], [], []
            for text in batch.column("text"):
                data = own.encode(text.as_py() or "") + last
                firsts.append(total)
                counts.append(len(data) // own.dtype.itemsize)
                ids.append(data)
                total += counts[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(firsts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["id", *made.fieldNames()],
            )

    schema = StructType([StructField("id", narrow.schema["id"].dataType), *made])
    return stored(narrow.mapInArrow(run, schema), "tokens")


def partition_offsets(tokens: DataFrame) -> DataFrame:
    """Ids in the stream before each part: a prefix sum over one row for each part."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))


def _cut(
    batches: Iterator[pa.RecordBatch], length: int, width: int
) -> Iterator[pa.RecordBatch]:
    kind = f"<u{width}"
    for batch in slices(batches):
        rows, columns = [], [[], [], [], [], [], []]
        firsts = batch.column("stream").to_pylist()
        for k, (first, data) in enumerate(zip(firsts, batch.column("ids"), strict=True)):
            ids = np.frombuffer(data.as_buffer(), kind)
            at = 0
            while at < ids.size:
                sequence, offset = divmod(first + at, length)
                size = min(length - offset, ids.size - at)
                piece = ids[at : at + size].astype("<u4").tobytes()
                rows.append(k)
                for column, value in zip(
                    columns, (at, size, piece, ids.size, sequence, offset), strict=True
                ):
                    column.append(value)
                at += size
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(rows, pa.int64()))]
            + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = 4096,
    end: int = 2,
) -> DataFrame:
    """Pieces: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file that every executor can read. ``ids``
    are 32-bit little-endian integers. ``start`` counts a document's ids before the
    piece, ``offset`` the sequence's. Makes and stores the ids when called.
    """
    tokens = tokenised(docs, doc_id, text, tokenizer, end)
    width = encoder(tokenizer).dtype.itemsize
    placed = tokens.join(F.broadcast(partition_offsets(tokens)), "part").select(
        "id", (F.col("before") + F.col("first")).alias("stream"), "ids"
    )
    made = fields_of("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    schema = StructType([StructField("id", tokens.schema["id"].dataType), *made])
    return placed.mapInArrow(lambda b: _cut(b, length, width), schema).withColumnRenamed(
        "id", doc_id
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, length and ids, at most one sequence a row."""
    part = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    return (
        pieces.groupBy("sequence_id")
        .agg(F.sum("length").alias("length"), part.alias("p"))
        .select("sequence_id", "length", whole.alias("ids"))
    )
