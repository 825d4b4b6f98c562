from __future__ import annotations

import random

import numpy as np
import pytest

from brute import near_groups
from freightlens.llm import near_dedup as op
from freightlens.llm.common import table
from freightlens.llm.components import connected_components
from freightlens.llm.queries import op7_minhash_join


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def varied(rng, base, share, vocabulary):
    return " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base)


@pytest.fixture(scope="module")
def family():
    """Copies at many distances of two texts, so that links form chains and gaps."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows = []
    for base in ([rng.choice(vocabulary) for _ in range(150)] for _ in range(2)):
        rows += [varied(rng, base, rng.random() * 0.06, vocabulary) for _ in range(60)]
    rows += [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("block", [512, 16])
def test_family_matches_brute_force(docs_of, family, monkeypatch, percent, block):
    monkeypatch.setattr(op, "BLOCK_CLASSES", block)
    got = result(op.near_duplicates(docs_of(family), percent=percent))
    assert got == sorted(near_groups(family, percent), key=repr)
    assert len({r[2] for r in got}) > 62


def test_edge_cases(docs_of):
    same = "a b c d e f g h"
    docs = [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "a b"),
        (5, " A  B\n"),
        (6, "b a"),
        (7, same),
        (8, same.upper()),
        (9, "x " * 30_000),
        (10, "x x x x x"),
        (11, "é b c d e f"),
        (12, "É b c d e f"),
    ]
    got = result(op.near_duplicates(docs_of(docs, ("Class", "component_id")), percent=85))
    assert got == sorted(near_groups(docs, 85), key=repr)


def test_null_and_repeated_ids(docs_of):
    same = "a b c d e f g h"
    rows = [(None, same), (None, same), (3, same), (3, same), (3, "other text with six words"), (5, same)]
    got = result(op.near_duplicates(docs_of(rows), percent=85))
    assert got.count((None, 4, None, True)) == 2
    assert got.count((3, 4, 3, True)) == 2 and (5, 4, 3, False) in got
    assert (3, 1, 3, True) in got and len(got) == 6


def test_empty_table(docs_of):
    assert result(op.near_duplicates(docs_of([]))) == []


def test_threshold_keeps_nearly_all_pairs():
    for percent in (80, 85, 95):
        t = op.match_threshold(percent)
        draws = np.random.default_rng(1).binomial(op.COORDINATES, percent / 100, 1_000_000)
        assert 1 <= t < op.COORDINATES and (draws < t).mean() < 1e-5


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 201), (200, 202), (202, 300)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(frame).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 201: 200, 202: 200, 300: 200}
    assert connected_components(frame.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = result(op7_minhash_join(spark, sf_dir))
    assert got == sorted(near_groups(docs, 85), key=repr) and not all(r[3] for r in got)
