from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from freightlens.llm.queries import op13_vector_codes
from freightlens.llm.vector_codes import (
    codebook_text,
    encode_vectors,
    fit_codebooks,
    nearest_entries,
)


def nearest(part, book):
    """(distance, index) by comparing with every entry."""
    return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """(codebooks, [(id, codes, error)]) of (id, vector) rows in plain Python."""
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    size = len(kept[0][1]) // parts if kept else 0
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = defaultdict(list)
            for c in cut:
                members[nearest(c[p], book)[1]].append(c[p])
            for i, own in members.items():
                book[i] = [sum(x) // len(own) for x in zip(*own)]
    coded = []
    for (i, _), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        coded.append((i, [k for _, k in found], sum(d for d, _ in found)))
    return books, coded


def same(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    books = fit_codebooks(df, **options)
    want_books, want = brute(rows, **options)
    assert [b.tolist() for b in books] == want_books
    got = [(r.vec_id, list(r.code), r.error) for r in encode_vectors(df, books).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("seed", range(3))
def test_search_finds_what_comparing_finds(seed):
    r = np.random.default_rng(seed)
    for spread, dim, count in ((3, 1, 9), (4, 4, 64), (300, 4, 64), (1 << 40, 2, 17)):
        rows, entries = r.integers(-spread, spread, (300, dim)), r.integers(-spread, spread, (count, dim))
        entries[count // 2] = entries[0]  # equal entries: the lower index counts
        found, best = nearest_entries(rows, entries)
        want = [nearest(row, entries.tolist()) for row in rows.tolist()]
        assert list(zip(best.tolist(), found.tolist())) == want


def test_codes_match_brute_force(spark):
    r = random.Random(3)
    same(spark, [(k, [r.gauss(0, 0.2) for _ in range(8)]) for k in range(150)], "double", parts=4, entries=9)


def test_ties_repeats_nulls_and_lengths(spark):
    r = random.Random(4)
    whole = [(k % 40, [float(r.randint(-1, 1)) / 256 for _ in range(8)]) for k in range(120)]
    odd = [
        (0, None), (1, []), (2, [0.0] * 7 + [None]), (3, [math.nan] + [0.0] * 7), (4, [math.inf] * 8),
        (None, [0.25] * 8), (None, [0.25] * 8), (50, [0.5] * 16), (51, [0.5] * 7),
    ]
    same(spark, whole + whole[:60] + odd, parts=4, entries=16)
    same(spark, [(-1, [1.0] * 16), *odd, (7, [0.1] * 4)], parts=4, entries=3)  # few rows of the first length
    same(spark, [(k, [float(k)] * 2) for k in range(5)], parts=2, entries=64)
    same(spark, [(k, [4e6 * (k % 3), -4e6]) for k in range(9)], "double", parts=1, entries=2)


def test_empty_table_and_names(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, code int, Error int")
    books = fit_codebooks(df)
    assert codebook_text(books) == "" and encode_vectors(df, books).collect() == []
    df = spark.createDataFrame([(1, [0.0] * 16, 5, 6)], df.schema)
    found = encode_vectors(df, fit_codebooks(df), keep=["code", "Error"])
    assert found.columns == ["vec_id", "code", "error"]
    assert [(r.vec_id, bytes(r.code), r.error) for r in found.collect()] == [(1, bytes(16), 0)]


def test_partitions_do_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    books = [codebook_text(fit_codebooks(df.repartition(n))) for n in (1, 5)]
    assert books[0] == books[1]


def test_label_errors_add_up(spark):
    rows = op13_vector_codes(spark, "/root/testdata/sf0.001").collect()
    assert len({r.codebooks_sha256 for r in rows}) == 1
    assert sum(r.error for r in rows) == sum({r.label_error for r in rows})
