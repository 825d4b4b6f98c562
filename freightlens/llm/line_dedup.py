"""Line dedup by pairwise alignment.

1. Every line that is not blank gets a 128-bit hash of its words in lower case. Repeated
   lines of a document are told apart by their number of occurrence.
2. The first holder of a line is the holder with the least (id, text hash). Each later
   holder is paired with it, so a line in any number of documents makes one pair for
   each later document, never all pairs.
3. Each pair is aligned by patience diff: lines that stand once in both documents and are
   rare in the corpus anchor the longest common order; a gap between two anchors is then
   aligned by lines that stand once in both, and the rest by all matched lines. Pairs
   without a rare line start with the second step, so frequent lines are treated too.
4. Aligned lines of a later document that follow each other, over all its pairs, make a
   common block. Blocks of at least ``min_words`` words are deleted from it.
5. The alignment has one order and uses each line of a first holder once. So passages are
   matched by themselves as well: each shortest run of lines, blank ones aside, of
   ``min_words`` words from a start or to an end gets a hash, and a later document loses
   every run that any earlier document holds in one piece, however often and in whatever
   order. A run of one line is that line.
6. A line with more than ``rare`` holders is deleted from all but its first holder if it
   has ``frequent_words`` words, whatever its block and however often it stands there.

Defined cases: a null text stays null and is never matched; a null id is never matched;
rows with equal id and text are one document and get equal results; rows that share an
id only are ordered by a hash of the text (in the number of holders of a line, equal rows
count one each). Blank lines and all first holders stay as they are, and so do short blocks
of lines with few holders, frequent lines under ``frequent_words`` words, and further or
crossing copies of a block that every earlier document has with other lines in between.
Lines end at a line feed. A text without deletions is returned unchanged; if all its lines
are deleted, the empty text remains.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from freightlens.llm.common import fields_of, slices, with_computed, without
from freightlens.sources import stored

#: A line that more documents hold is not rare.
RARE = 16
#: Words that a common block must have.
MIN_WORDS = 10
#: Words that a line must have to be cut alone if it is not rare; one word is often chance.
FREQUENT_WORDS = 2

_LINE = "pos int, stop int, code binary, nth int, once boolean"
#: Number of occurrence of a passage: all copies are alike.
_PASSAGE = -1


def _normal(line: str) -> str:
    return " ".join(line.lower().split())


def _digest(words: str) -> bytes:
    return blake2b(words.encode(), digest_size=16).digest()


def passages(counts: list[int], min_words: int) -> set[tuple[int, int]]:
    """First and last line of the runs of two lines or more that reach min_words, and would not
    without their last line or without their first; ``counts`` are the lines' words."""
    out = set()
    first = last = words = 0
    for last, own in enumerate(counts):
        words += own
        while words - counts[first] >= min_words:
            words -= counts[first]
            first += 1
        if words >= min_words and first < last:
            out.add((first, last))
    words, last = 0, len(counts) - 1
    for first in range(len(counts) - 1, -1, -1):
        words += counts[first]
        while words - counts[last] >= min_words:
            words -= counts[last]
            last -= 1
        if words >= min_words and first < last:
            out.add((first, last))
    return out


def document_lines(docs: DataFrame, doc_id: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, own, pos, stop, code, nth, once) of each line with words; ``own`` is the text's hash.

    Passages of several lines have rows too, from ``pos`` to ``stop``, with nth -1.
    """
    narrow = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(
        F.col(f"`{doc_id}`").alias("id"),
        F.xxhash64(f"`{text}`").alias("own"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    made = fields_of(_LINE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, places, stops, codes, numbers, single = [], [], [], [], [], []
            for k, value in enumerate(batch.column("text")):
                normal = [
                    (at, words)
                    for at, line in enumerate((value.as_py() or "").split("\n"))
                    if (words := _normal(line))
                ]
                lines = [(at, _digest(words)) for at, words in normal]
                times, seen = Counter(code for _, code in lines), Counter()
                for at, code in lines:
                    rows.append(k)
                    places.append(at)
                    stops.append(at)
                    codes.append(code)
                    numbers.append(seen[code])
                    single.append(times[code] == 1)
                    seen[code] += 1
                for first, last in passages([w.count(" ") + 1 for _, w in normal], min_words):
                    rows.append(k)
                    places.append(normal[first][0])
                    stops.append(normal[last][0])
                    codes.append(_digest("\n".join(w for _, w in normal[first : last + 1])))
                    numbers.append(_PASSAGE)
                    single.append(False)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(taken),
                    batch.column("own").take(taken),
                    pa.array(places, pa.int32()),
                    pa.array(stops, pa.int32()),
                    pa.array(codes, pa.binary()),
                    pa.array(numbers, pa.int32()),
                    pa.array(single, pa.bool_()),
                ],
                names=["id", "own", *made.fieldNames()],
            )

    schema = StructType([StructField("id", narrow.schema["id"].dataType), *fields_of("own long"), *made])
    return narrow.mapInArrow(run, schema)


def _longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing run of values, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for k, value in enumerate(values):
        at = bisect_left(tops, value)
        if at == len(tops):
            tops.append(value)
            piles.append(k)
        else:
            tops[at], piles[at] = value, k
        before[k] = piles[at - 1] if at else -1
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def patience_alignment(matches: list[tuple[int, int, int]]) -> list[int]:
    """Places in the later document of a common order of matched lines.

    ``matches`` are (place in the later, place in the first, level), where lines of
    level 2 anchor first, then those of level 1 inside the gaps, then all others.
    """
    matches = sorted(matches)

    def align(items: list[tuple[int, int, int]], level: int) -> list[tuple[int, int, int]]:
        anchors = [m for m in items if m[2] >= level]
        chosen = [anchors[k] for k in _longest_increasing([m[1] for m in anchors])]
        if level == 0:
            return chosen
        out, at = [], 0
        low_b = low_a = -1
        for anchor in [*chosen, None]:
            gap = []
            while at < len(items) and (anchor is None or items[at][0] < anchor[0]):
                place, other, _ = items[at]
                if place > low_b and other > low_a and (anchor is None or other < anchor[1]):
                    gap.append(items[at])
                at += 1
            out += align(gap, level - 1) if gap else []
            if anchor is not None:
                out.append(anchor)
                low_b, low_a = anchor[:2]
                at += 1
        return out

    return [m[0] for m in align(matches, 2)]


def aligned_lines(lines: DataFrame, rare: int = RARE) -> DataFrame:
    """(id, own, places, held, frequent, passages): the lines of each later document that align
    with a first holder, the first copies of those that an earlier document holds, the not rare
    ones among them, and the passages that an earlier document holds."""
    holder = F.struct("id", "own")
    first = lines.groupBy("code", "nth").agg(
        F.min(F.struct("id", "own", "pos", "once")).alias("first"),
        F.max(holder).alias("last"),
        F.count(F.lit(1)).alias("holders"),
    )
    first = first.where("struct(first.id, first.own) != last").select(
        "code",
        "nth",
        F.col("first.id").alias("a_id"),
        F.col("first.own").alias("a_own"),
        F.col("first.pos").alias("a_pos"),
        F.col("first.once").alias("a_once"),
        (F.col("holders") <= rare).alias("rare"),
    )
    once = F.col("once") & F.col("a_once")
    level = F.when(once & F.col("rare"), 2).when(once, 1).otherwise(0)
    # stored, so that the join may split a line that very many documents hold
    first = stored(first, "first-holders")
    matched = lines.join(first, ["code", "nth"]).where("id != a_id or own != a_own")
    pairs = matched.groupBy("id", "own", "a_id", "a_own").agg(
        F.collect_set(F.struct("pos", "stop", "nth", "a_pos", level.alias("level"), "rare")).alias("matches")
    )

    def align(matches: pa.Array) -> list[list]:
        out = []
        for pair in matches.to_pylist():
            lines = [(m["pos"], m["a_pos"], m["level"]) for m in pair if m["nth"] != _PASSAGE]
            aligned = set(patience_alignment(lines))
            out.append(
                [
                    {
                        "place": m["pos"],
                        "stop": m["stop"] if m["nth"] == _PASSAGE else None,
                        "aligned": m["nth"] != _PASSAGE and m["pos"] in aligned,
                        "held": m["nth"] == 0,
                        "frequent": m["nth"] == 0 and not m["rare"],
                    }
                    for m in pair
                ]
            )
        return [out]

    found = with_computed(
        pairs.select("id", "own", "matches"),
        ["matches"],
        "found array<struct<place: int, stop: int, aligned: boolean, held: boolean, frequent: boolean>>",
        align,
    )
    flat = found.select("id", "own", F.inline("found"))
    return flat.groupBy("id", "own").agg(
        *(
            F.array_sort(F.collect_set(F.when(F.col(kind), F.col("place")))).alias(name)
            for kind, name in (("aligned", "places"), ("held", "held"), ("frequent", "frequent"))
        ),
        F.collect_set(F.when(F.col("stop").isNotNull(), F.struct("place", "stop"))).alias("passages"),
    )


def common_blocks(text: str, places: list[int], min_words: int) -> list[int]:
    """The places, taken in runs without another line with words between, of long runs only."""
    out: list[int] = []
    run: list[int] = []
    words = 0
    wanted = set(places)
    for at, line in enumerate([*text.split("\n"), None]):
        own = len(line.split()) if line is not None else 0
        if line is not None and not own:
            continue
        if line is not None and at in wanted:
            run.append(at)
            words += own
            continue
        if words >= min_words:
            out += run
        run, words = [], 0
    return out


def repeated_lines(
    lines: list[str], held: list[int], frequent: list[int], min_words: int, frequent_words: int
) -> set[int]:
    """The places of all copies of held lines that reach the floor alone."""
    often = set(frequent)
    codes = set()
    for at in held:
        if len(lines[at].split()) >= (frequent_words if at in often else min_words):
            codes.add(_normal(lines[at]))
    return {at for at, line in enumerate(lines) if _normal(line) in codes} if codes else set()


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rare: int = RARE,
    min_words: int = MIN_WORDS,
    frequent_words: int = FREQUENT_WORDS,
) -> DataFrame:
    """The rows with common blocks and frequent lines cut from ``text``, n_lines and deleted_lines.

    ``n_lines`` counts the original lines, ``deleted_lines`` has the places of those cut,
    from 0. Stores the lines (hashes, not texts) when called.
    """
    lines = stored(document_lines(docs, doc_id, text, min_words), "lines")
    aligned = aligned_lines(lines, rare).select(
        F.col("id").alias("__id"),
        F.col("own").alias("__own"),
        F.col("places").alias("__places"),
        F.struct("held", "frequent", "passages").alias("__held"),
    )
    base = without(docs, "n_lines", "deleted_lines")
    same = (F.col(f"`{doc_id}`") == F.col("__id")) & (F.xxhash64(f"`{text}`") == F.col("__own"))
    joined = base.join(aligned, same, "left").drop("__id", "__own")

    def cut(texts: pa.Array, places: pa.Array, held: pa.Array) -> list[list]:
        out: list[list] = [[], [], []]
        for value, own, other in zip(texts, places, held, strict=True):
            value, own, other = value.as_py(), own.as_py(), other.as_py()
            drop = set(common_blocks(value, own, min_words)) if own else set()
            if other:
                lines = value.split("\n")
                drop |= repeated_lines(lines, other["held"], other["frequent"], min_words, frequent_words)
                for run in other["passages"]:
                    drop.update(at for at in range(run["place"], run["stop"] + 1) if lines[at].split())
            gone = sorted(drop)
            if gone:
                kept = [x for at, x in enumerate(value.split("\n")) if at not in drop]
                left = "\n".join(kept)
            else:
                left = value
            out[0].append(left)
            out[1].append(value.count("\n") + 1 if value is not None else 0)
            out[2].append(gone)
        return out

    ddl = f"`{text}` string, n_lines int, deleted_lines array<int>"
    result = with_computed(joined, [text, "__places", "__held"], ddl, cut)
    names = [*(c for c in base.columns), "n_lines", "deleted_lines"]
    return result.select(*(result[f"`{c}`"] for c in names))
