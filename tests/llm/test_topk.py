from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pytest

from brute import top_scores
from freightlens.llm.common import table
from freightlens.llm.oracle import ORACLE
from freightlens.llm.queries import op8_threshold_topk
from freightlens.llm.topk import top_k
from oracle_compare import differences

SCHEMA = "vec_id long, embedding array<float>, Rank string"


def got_and_wanted(spark, rows, is_query, k=20, **options):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    queries = frame.where("vec_id % 2 = 0") if is_query is even else frame
    exact = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = top_k(frame, queries, k, **options).collect()
    return sorted(tuple(r) for r in got), sorted(top_scores(exact, is_query, k))


def even(x):
    return x % 2 == 0


def test_ties_nulls_and_blocks(spark):
    rng = random.Random(3)
    rows = [(k, [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for k in range(60)]
    rows += [(100, None), (102, []), (104, [None, 1.0, 1.0]), (106, [float("nan")] * 3)]
    rows += [(108, [float("inf"), 0.0, 0.0]), (110, [0.0, 0.0, 0.0]), (112, [1.0, 2.0])]
    rows += [(114, [3.0, 4.0]), (115, [-3.0, 1.0]), (116, [1.0])]
    for options in ({}, {"block": 7, "packet": 5}):
        got, want = got_and_wanted(spark, rows, even, 5, **options)
        assert got == want


def test_equal_vectors_take_the_smaller_ids(spark):
    rows = [(k, [0.5, -0.25]) for k in range(300)]
    got, want = got_and_wanted(spark, rows, even, 4, block=32)
    assert got == want


def test_large_components_are_exact(spark):
    """Scores beyond what a double holds exactly."""
    rows = [(k, [float(2**24 + k * 4), float(-(2**22)), 1.0]) for k in range(12)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in top_k(frame, frame, 3).collect())
    assert got == sorted(top_scores(rows, lambda q: True, 3)) and min(r[3] for r in got) > 2**53


def test_empty_and_null_ids(spark):
    frame = spark.createDataFrame([(None, [1.0], "x"), (2, [1.0], "x")], SCHEMA)
    assert top_k(frame, frame).count() == 0
    assert top_k(frame.limit(0), frame).count() == 0


@pytest.mark.parametrize("block", [2, 4096])
def test_repeated_rows_each_count(spark, block):
    """As in the statement: every row is a candidate, and query rows of one id share its ranks."""
    rows = [(2, [1.0]), (3, [2.0]), (3, [2.0]), (3, [2.5]), (5, [0.5]), *[(7, [1.0])] * 4, (40, [1.0]), (40, [1.0])]
    rows += [(60, [1.0]), (60, [-1.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = top_k(frame, frame.where("vec_id % 20 = 0"), block=block)
    con = duckdb.connect()
    con.register("given", pa.table({"vec_id": [i for i, _ in rows], "embedding": [v for _, v in rows]}))
    con.sql("CREATE VIEW embeddings AS SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM given")
    assert differences(got, con.sql(ORACLE["op8_threshold_topk"])) == []
    small = top_k(frame.where("vec_id < 4"), frame.where("vec_id = 2"), 5)
    assert sorted(map(tuple, small.collect())) == [(2, 1, 3, 64 * 160), (2, 2, 3, 64 * 128), (2, 3, 3, 64 * 128)]


def test_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    got = sorted(tuple(r) for r in op8_threshold_topk(spark, sf_dir).collect())
    assert got == sorted(top_scores(rows, lambda q: q % 20 == 0))
