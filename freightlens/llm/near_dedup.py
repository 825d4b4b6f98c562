"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Texts are reduced to classes of equal word sequences; each class gets a signature of
   ``COORDINATES`` minimum hashes over its distinct shingles. A value is coded with its
   coordinate, so that a signature is a set of codes.
2. Prefix: classes are posted under their codes. Two classes that agree in at least
   ``t`` of ``k`` codes share one among the k - t + 1 rarest of each, so only these are
   posted; a code that a single class has takes a place but needs no posting. Most
   classes have that many codes of their own and drop out here.
3. Match counts: every class of a posting list is compared with the list's least class,
   and those that agree in ``t`` codes are joined into candidate groups. Skip merging:
   a list whose classes are all in one group is skipped; in the others, classes of
   different groups are compared with each other, in blocks, inside the tasks.
4. Confirmation: inside each candidate group, full shingle sets are compared, again in
   blocks. A block task returns a spanning forest of the links it found, not the pairs.
   Components over these links are the result.

``t`` is set so that a pair at the wanted similarity misses it with a probability under
1e-9. Lists and groups of any size are split into blocks, so no task holds more than two
blocks. Classes that do not link inside one hot list are compared pairwise by blocks;
that work, not the output, grows with the square of their number.

Defined cases: a text that is null or has no words has no shingle and is linked with
nothing; fewer words than a shingle make one shingle. Rows with a null id are linked
with nothing. Rows that share an id but not the text are judged apart. Equal rows get
equal results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from freightlens.llm.bloom import block_count, with_possible
from freightlens.llm.common import (
    LOWER,
    NOT_BLANK,
    byte_arrays,
    fields_of,
    mixed,
    slices,
    window_hashes,
    word_bounds,
    word_hashes,
)
from freightlens.llm.components import connected_components
from freightlens.sources import stored

#: Signature length.
COORDINATES = 64
#: Accepted probability that a pair at the threshold agrees in too few coordinates.
MISS = 1e-9
#: A block's classes and shingles; a task holds two blocks.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1_000_000

_RANDOM = np.random.default_rng(8111)
_FACTORS = _RANDOM.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _RANDOM.integers(1, 2**63, COORDINATES, dtype=np.uint64)
_COORDINATE = np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)


def match_threshold(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest t so that a pair of this similarity agrees in under t with probability < miss."""
    p, below = percent / 100, 0.0
    for t in range(coordinates):
        below += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below >= miss:
            return max(1, t)
    return coordinates


def shingle_hashes(text: np.ndarray, size: int) -> tuple[bytes, np.ndarray]:
    """The text's words, normalised and joined, and the distinct hashes of its shingles."""
    low = LOWER[text]
    words = word_hashes(low, *word_bounds(low, NOT_BLANK))
    hashes = window_hashes(words, min(size, words.size)) if words.size else words
    return b" ".join(low.tobytes().split()), np.unique(hashes)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The coded minimum of each coordinate's hash over the shingles."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for at in range(0, hashes.size, 2048):
        part = (hashes[at : at + 2048, None] ^ _FLIPS) * _FACTORS
        least = np.minimum(least, part.min(axis=0))
    return mixed(least + _COORDINATE).view(np.int64)


def _digest(normal: bytes) -> bytes:
    return blake2b(normal, digest_size=16).digest()


def signed(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(id, class, shingles, signature) of each row, stored; class is null without words."""
    narrow = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")
    )
    made = fields_of("class binary, shingles long, signature array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            classes, counts, signatures = [], [], []
            for data in byte_arrays(batch.column("text")):
                normal, hashes = shingle_hashes(data, size) if data is not None else (b"", ())
                classes.append(_digest(normal) if normal else None)
                counts.append(len(hashes))
                signatures.append(signature(hashes) if normal else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(classes, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(signatures, pa.list_(pa.int64())),
                ],
                names=["id", *made.fieldNames()],
            )

    schema = StructType([StructField("id", narrow.schema["id"].dataType), *made])
    return stored(narrow.mapInArrow(run, schema), "signed")


def posted_prefixes(classes: DataFrame, threshold: int) -> DataFrame:
    """(code, class): each class under the rarest of its codes that other classes have too."""
    prefix = COORDINATES - threshold + 1
    codes = classes.select("class", F.explode("signature").alias("code"))
    shared = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = codes.join(shared, "code").groupBy("class")
    ordered = common.agg(F.array_sort(F.collect_list(F.struct("n", "code"))).alias("codes"))
    taken = prefix - (COORDINATES - F.size("codes"))
    short = ordered.where(taken > 0).select("class", F.slice("codes", F.lit(1), taken).alias("c"))
    return short.select(F.explode("c.code").alias("code"), "class")


def _agreeing(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _cells(blocks: Column, own: Column) -> Column:
    """The unordered pairs of blocks that a member of block ``own`` takes part in."""
    every = F.sequence(F.lit(0), blocks - 1)
    return F.transform(
        every, lambda j: F.struct(F.least(j, own).alias("low"), F.greatest(j, own).alias("high"))
    )


def _forest(link: np.ndarray, names: list[bytes]) -> pa.Table:
    """Each member of a component, but its least, with that least member."""
    order = sorted(range(len(names)), key=names.__getitem__)
    link, names = link[np.ix_(order, order)], [names[k] for k in order]
    root = np.full(len(names), -1)
    for first in range(len(names)):
        if root[first] >= 0:
            continue
        reached = np.zeros(len(names), bool)
        fresh = reached.copy()
        reached[first] = fresh[first] = True
        while fresh.any():
            fresh = link[fresh].any(axis=0) & ~reached
            reached |= fresh
        root[reached] = first
    at = np.flatnonzero(root != np.arange(len(names)))
    return pa.table(
        {
            "a": pa.array([names[root[k]] for k in at], pa.binary()),
            "b": pa.array([names[k] for k in at], pa.binary()),
        }
    )


def _across(low: int, high: int, block: np.ndarray) -> np.ndarray:
    """Which pairs a cell of blocks low and high has to compare."""
    if low == high:
        return ~np.eye(block.size, dtype=bool)
    return block[:, None] != block[None, :]


def _agree_in_cell(threshold: int):
    def run(cell: pa.Table) -> pa.Table:
        names = cell.column("class").to_pylist()
        groups = np.unique(np.array(cell.column("group").to_pylist(), object), return_inverse=True)[1]
        codes = np.array(cell.column("signature").to_pylist(), np.int64)
        low, high = cell.column("low")[0].as_py(), cell.column("high")[0].as_py()
        wanted = _across(low, high, cell.column("block").to_numpy())
        wanted &= groups[:, None] != groups[None, :]
        if not wanted.any():
            return _forest(wanted, names)
        same = np.zeros(wanted.shape, np.int16)
        for k in range(codes.shape[1]):
            same += codes[:, k, None] == codes[None, :, k]
        return _forest(wanted & (same >= threshold), names)

    return run


def _confirm_in_cell(percent: int):
    def run(cell: pa.Table) -> pa.Table:
        at = {name: k for k, name in enumerate(cell.column("class").to_pylist())}
        rows, names = list(at.values()), list(at)  # repeated rows count once
        packed = cell.column("set").to_pylist()
        sets = [np.frombuffer(packed[k], np.uint64) for k in rows]
        sizes = np.array([s.size for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, number, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = uses[number] > 1
        number, owner = number[keep], owner[keep]
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        number = np.cumsum(np.diff(number, prepend=number[:1]) != 0)
        both = np.zeros((len(sets), len(sets)), np.float32)
        for first in range(0, int(number[-1]) + 1 if number.size else 0, 2048):
            a, b = np.searchsorted(number, [first, first + 2048])
            has = np.zeros((len(sets), 2048), np.float32)
            has[owner[a:b], number[a:b] - first] = 1
            both += has @ has.T
        both = both.astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - both
        block = cell.column("block").to_numpy()[rows]
        low, high = cell.column("low")[0].as_py(), cell.column("high")[0].as_py()
        return _forest((100 * both >= percent * union) & _across(low, high, block), names)

    return run


def candidate_groups(classes: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the classes that agree in enough coordinates, directly or in steps."""
    threshold = match_threshold(percent)
    posted = stored(posted_prefixes(classes, threshold), "posted")
    posted_classes = posted.select("class").distinct()
    signatures = stored(
        classes.join(posted_classes, "class", "left_semi").select("class", "signature"),
        "signatures",
    )
    least = posted.groupBy("code").agg(F.min("class").alias("pivot"))
    pairs = posted.join(least, "code").where("class != pivot").select("class", "pivot").distinct()
    pivots = signatures.select(F.col("class").alias("pivot"), F.col("signature").alias("other"))
    stars = (
        pairs.join(signatures, "class")
        .join(pivots, "pivot")
        .where(_agreeing(F.col("signature"), F.col("other")) >= threshold)
        .select(F.col("pivot").alias("a"), F.col("class").alias("b"))
    )
    stars = stored(stars, "stars")
    # a class belongs to the least class it was matched with; that is enough to see most
    # of what is joined already, and what it misses is only compared once more
    matched = stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    grouped = posted.join(matched, posted["class"] == matched["node"], "left").select(
        "code", "class", F.least(F.coalesce("root", "class"), "class").alias("group")
    )
    lists = grouped.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.min("group").alias("g"), F.max("group").alias("h")
    )
    unmerged = lists.where("g != h").select(
        "code", F.ceil(F.col("n") / BLOCK_CLASSES).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    cells = (
        grouped.join(unmerged, "code")
        .withColumn("block", block)
        .join(signatures, "class")
        .withColumn("cell", F.explode(_cells(F.col("blocks"), F.col("block"))))
        .select("code", "cell.low", "cell.high", "block", "class", "group", "signature")
    )
    more = cells.groupBy("code", "low", "high").applyInArrow(
        _agree_in_cell(threshold), "a binary, b binary"
    )
    return connected_components(stars.unionByName(stored(more, "merged")))


def confirmed_links(
    docs: DataFrame,
    classes: DataFrame,
    groups: DataFrame,
    doc_id: str,
    text: str,
    size: int,
    percent: int,
) -> DataFrame:
    """Spanning forests (a, b) of the links inside candidate groups, from full shingle sets."""
    members = groups.select(F.col("node").alias("class"), F.col("root").alias("group"))
    roots = groups.select(F.col("root").alias("class"), F.col("root").alias("group")).distinct()
    members = members.unionByName(roots).join(
        classes.select("class", "first", "shingles"), "class"
    )
    blocks = members.groupBy("group").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)
        )
        .cast("int")
        .alias("blocks")
    )
    members = stored(members.join(blocks, "group").drop("shingles"), "members")
    texts = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")
    )
    # only texts that may be members' are shuffled to them
    wanted = members.select("first").distinct()
    texts = with_possible(texts, "id", wanted, "first", block_count(wanted.count()))
    texts = texts.where("__maybe")
    found = texts.join(members, texts["id"] == members["first"]).select(
        "group", "class", "blocks", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, sets = [], []
            named = zip(batch.column("class").to_pylist(), byte_arrays(batch.column("text")), strict=True)
            for k, (name, data) in enumerate(named):
                if data is None:
                    continue
                normal, hashes = shingle_hashes(data, size)
                if _digest(normal) == name:  # an id may have other texts besides
                    rows.append(k)
                    sets.append(hashes.tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("group", "class", "blocks"))]
                + [pa.array(sets, pa.binary())],
                names=["group", "class", "blocks", "set"],
            )

    sets = found.mapInArrow(run, "group binary, class binary, blocks int, set binary")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    cells = (
        sets.withColumn("block", block)
        .withColumn("cell", F.explode(_cells(F.col("blocks"), F.col("block"))))
        .select("group", "cell.low", "cell.high", "block", "class", "set")
    )
    return cells.groupBy("group", "low", "high").applyInArrow(
        _confirm_in_cell(percent), "a binary, b binary"
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Each row's id, n_shingles, component_id and kept.

    Rows are linked if 100 * |intersection| >= percent * |union| of their shingle sets;
    ``component_id`` is the least id that links reach, and ``kept`` tells whether it is
    the row's own (true for a null id). Runs jobs and stores tables when called.
    """
    rows = signed(docs, doc_id, text, size)
    classes = rows.where("class is not null and id is not null").groupBy("class").agg(
        F.min("id").alias("first"),
        F.first("shingles").alias("shingles"),
        F.first("signature").alias("signature"),
    )
    classes = stored(classes, "classes")
    groups = candidate_groups(classes, percent)
    links = confirmed_links(docs, classes, groups, doc_id, text, size, percent)
    linked = connected_components(links)
    placed = classes.join(linked, classes["class"] == linked["node"], "left").select(
        "class", "first", F.coalesce("root", "class").alias("root")
    )
    leasts = placed.groupBy("root").agg(F.min("first").alias("component"))
    component = placed.join(leasts, "root").select(F.col("class").alias("of"), "component")
    out = rows.join(component, (rows["class"] == component["of"]) & rows["id"].isNotNull(), "left")
    own = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(doc_id),
        F.col("shingles").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
    )
