"""Benchmark decontamination by a broadcast hash set of test n-grams.

The words of a benchmark item make windows of ``n`` consecutive words; an item of
fewer words, but not none, is one window. The hashes of all windows are broadcast,
every window of every document is looked up, and a hit is verified word by word.

The set is bounded: it holds at most about ``max_windows`` (window, item) pairs.
Larger benchmarks are dealt into several blocks, and the documents pass one block
after the other, with a stored table between, so that memory stays the same.

Defined cases: a null text has no words; a null or empty item has no window and
never occurs; equal items each count; documents with a null or repeated id are judged one
by one; items with a null id hit like others, count as one item, come last in ``item_ids``
as null and are left out where ids are joined to a name; empty tables give no hits; columns that bear the name of a result column are
replaced, all others are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.common import (
    ALPHANUMERIC,
    LOWER,
    byte_arrays,
    window_hashes,
    with_computed,
    without,
    word_bounds,
    word_hashes,
)
from freightlens.sources import stored

#: (window, item) pairs that are broadcast at once; about 30 MB of Python objects.
MAX_WINDOWS = 200_000

_FOUND = "n_words long, hit_spans array<struct<first:long,last:long>>, item_ids array<string>"


class _Words:
    """The words of one text."""

    def __init__(self, text: np.ndarray) -> None:
        low = LOWER[text]
        self.starts, self.ends = word_bounds(low, ALPHANUMERIC)
        self.hashes = word_hashes(low, self.starts, self.ends)
        self.low = low

    def joined(self, first: int, last: int) -> bytes:
        spans = zip(self.starts[first:last].tolist(), self.ends[first:last].tolist(), strict=True)
        return b" ".join(self.low[a:b].tobytes() for a, b in spans)


def benchmark_windows(
    benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = 10
) -> DataFrame:
    """Distinct (code, size, words, item): each window's hash, word count, words and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sizes, words, items = [], [], [], []
            names = batch.column("item").to_pylist()
            for item, data in zip(names, byte_arrays(batch.column("text")), strict=True):
                if data is None:
                    continue
                own = _Words(data)
                size = min(n, own.hashes.size)
                if not size:
                    continue
                for k, code in enumerate(window_hashes(own.hashes, size).view(np.int64).tolist()):
                    codes.append(code)
                    sizes.append(size)
                    words.append(own.joined(k, k + size))
                    items.append(item)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(codes, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.array(words, pa.binary()),
                    pa.array(items, pa.string()),
                ],
                names=["code", "size", "words", "item"],
            )

    narrow = benchmark.select(
        F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text")
    )
    return narrow.mapInArrow(run, "code long, size int, words binary, item string").distinct()


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _scan(docs: DataFrame, text: str, block: list) -> DataFrame:
    """Add what one block of windows hits to what earlier blocks have hit."""
    by_code: dict[int, list[tuple[bytes, str | None]]] = {}
    by_size: dict[int, set[int]] = {}
    for code, size, words, item in block:
        by_code.setdefault(code, []).append((bytes(words), item))
        by_size.setdefault(size, set()).add(code)
    codes = {s: np.sort(np.array(list(c), np.int64).view(np.uint64)) for s, c in by_size.items()}

    def hits(own: _Words) -> tuple[list[tuple[int, int]], set[str | None]]:
        spans, items = [], set()
        for size, wanted in codes.items():
            windows = window_hashes(own.hashes, size)
            if not windows.size:
                continue
            at = np.minimum(np.searchsorted(wanted, windows), wanted.size - 1)
            for k in np.flatnonzero(wanted[at] == windows).tolist():
                words = own.joined(k, k + size)
                same = [i for w, i in by_code[int(windows[k].view(np.int64))] if w == words]
                if same:
                    spans.append((k, k + size))
                    items.update(same)
        return spans, items

    def compute(texts: pa.Array, spans: pa.Array, items: pa.Array) -> list[list]:
        counts, all_spans, all_items = [], [], []
        was = zip(spans.to_pylist(), items.to_pylist(), strict=True)
        for data, (old_spans, old_items) in zip(byte_arrays(texts), was, strict=True):
            if data is None:
                counts.append(0)
                all_spans.append([])
                all_items.append([])
                continue
            own = _Words(data)
            new_spans, new_items = hits(own)
            old = [(s["first"], s["last"]) for s in old_spans]
            counts.append(int(own.hashes.size))
            all_spans.append([{"first": a, "last": b} for a, b in _merged(old + new_spans)])
            every = new_items.union(old_items)
            all_items.append(sorted(every, key=lambda item: (item is None, item or "")))
        return [counts, all_spans, all_items]

    return with_computed(docs, [text, "hit_spans", "item_ids"], _FOUND, compute)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """The documents with n_words, hit_spans, item_ids and n_hit.

    ``hit_spans`` are runs of word positions, end exclusive, that lie inside an
    occurrence of a window; ``item_ids`` are the items with occurring windows, sorted as
    strings, null last; ``n_hit`` counts the words hit. Runs jobs over the benchmark when called.
    """
    windows = stored(benchmark_windows(benchmark, item_id, item_text, n), "windows")
    blocks = max(1, math.ceil(windows.count() / max_windows))
    block = F.pmod(F.xxhash64("words", "item"), F.lit(blocks))
    found = without(docs, "n_words", "hit_spans", "item_ids", "n_hit")
    found = found.withColumns(
        {
            "hit_spans": F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"),
            "item_ids": F.expr("cast(array() as array<string>)"),
        }
    )
    for k in range(blocks):
        found = _scan(found, text, windows.where(block == k).collect())
        if k + 1 < blocks:
            found = stored(found, "scanned")
    return found.withColumn(
        "n_hit",
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"]),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    mode: str = "documents",
    **options,
) -> DataFrame:
    """The documents' own columns after removal.

    ``mode`` "documents" drops every document with a hit; "spans" cuts the hit words,
    from the first byte of a run to the last, out of the text and keeps the document.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode}")
    found = find_contamination(docs, benchmark, text, **options)
    if mode == "documents":
        return found.where("n_hit = 0").select(*(found[f"`{c}`"] for c in docs.columns))

    def cut(texts: pa.Array, spans: pa.Array) -> list[list]:
        out = []
        for data, own in zip(byte_arrays(texts), spans.to_pylist(), strict=True):
            if data is None:
                out.append(None)
                continue
            starts, ends = word_bounds(LOWER[data], ALPHANUMERIC)
            parts, at = [], 0
            for s in own:
                parts.append(data[at : starts[s["first"]]].tobytes())
                at = ends[s["last"] - 1]
            out.append(b"".join([*parts, data[at:].tobytes()]).decode())
        return [out]

    result = with_computed(found, [text, "hit_spans"], f"`{text}` string", cut)
    return result.select(*(result[f"`{c}`"] for c in docs.columns))
