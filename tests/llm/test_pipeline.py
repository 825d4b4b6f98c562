"""The pipeline's stages against plain versions, and its handling of odd rows."""

from __future__ import annotations

import shutil
from collections import defaultdict

import pytest

import corpus_pipeline
from brute import contamination, near_groups
from freightlens.llm.common import table
from freightlens.llm.line_dedup import MIN_WORDS
from freightlens.llm.quality import classify_quality
from freightlens.llm.queries import graded_labels
from freightlens.sources import stored
from test_packing import check

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents and what each stage returns."""
    from freightlens.llm.common import ship

    ship(spark)
    out = [table(spark, SF_DIR, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF_DIR), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "near_dedup", "benchmark_decontamination", "packing",
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns_are_those_of_documents(steps):
    assert all(s.dtypes == steps[0].dtypes for s in steps[1:5])


def test_quality_stage(spark, steps):
    judged = classify_quality(steps[0], graded_labels(spark, SF_DIR))
    kept = {r.doc_id for r in judged.where("kept").collect()}
    assert texts(steps[1]) == {k: v for k, v in texts(steps[0]).items() if k in kept}
    assert 0 < len(kept) < steps[0].count()


def normal(line):
    return " ".join(line.lower().split())


def test_line_stage(steps):
    before, after = texts(steps[1]), texts(steps[2])
    held: set[str] = set()
    for doc in sorted(before):
        lines = before[doc].split("\n")
        kept = after.get(doc, "").split("\n")
        assert all(x in lines for x in kept if x)
        gone = [x for x in lines if x not in kept]
        assert all(normal(x) in held for x in gone)
        assert not any(
            len(x.split()) >= MIN_WORDS and normal(x) in held for x in kept
        )
        held |= {normal(x) for x in lines if normal(x)}
    for r in steps[2].collect():
        assert r.n_chars == len(r.text) or r.text == before[r.doc_id]


def test_near_stage(steps):
    before = texts(steps[2])
    kept = {r[0] for r in near_groups(list(before.items()), 80) if r[3]}
    assert texts(steps[3]) == {k: before[k] for k in kept}


def test_near_stage_judges_rows_that_share_an_id_apart(spark, docs_of):
    first, other = (" ".join(f"{w}{k}" for k in range(60)) for w in ("a", "b"))
    rows = [
        (1, first), (2, f"{first} end"), (2, other), (3, "clean words of its own"),
        (4, f"{other} end"), (5, f"c {other}"), (5, "c"), (6, "d e f"), (6, "g h i"), (None, first),
    ]
    twice = [(7, " ".join(f"z{k}" for k in range(60))), (7, " ".join(f"z{k}" for k in range(61)))]
    found = corpus_pipeline.near_dedup(spark, docs_of([*rows, *twice]), SF_DIR).collect()
    got = [(r.doc_id, r.text) for r in found]
    kept = [rows[k] for k in (0, 2, 3, 6, 7, 8, 9)]
    assert sorted((r for r in got if r[0] != 7), key=repr) == sorted(kept, key=repr)
    assert len([r for r in got if r in twice]) == 1


def test_near_stage_keeps_one_of_equal_rows(spark, docs_of):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long)] * 50 + [(2, long)] * 3 + [(3, "")] * 4 + [(4, None)] * 2 + [(None, "a")] * 2 + [(4, "b c")]
    found = corpus_pipeline.near_dedup(spark, docs_of(rows).repartition(7), SF_DIR).collect()
    want = [(1, long), (3, ""), (4, None), (None, "a"), (None, "a"), (4, "b c")]
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted(want, key=repr)


def test_decontamination_stage(spark, steps):
    items = [(r[0], r[1]) for r in table(spark, SF_DIR, "benchmark").collect()]
    before = texts(steps[3])
    clean = {r[0] for r in contamination(list(before.items()), items) if not r[-1]}
    assert texts(steps[4]) == {k: before[k] for k in clean}


def test_packing_stage(steps):
    check(steps[5].collect(), list(texts(steps[4]).items()), 4096)


def test_run_gives_the_last_stage(spark, steps):
    got, want = corpus_pipeline.run(spark, SF_DIR), steps[5]
    assert sum(r.length for r in got.collect()) == sum(r.length for r in want.collect())


@pytest.fixture
def odd(spark, tmp_path):
    """A folder with odd documents; the other tables are the given ones."""
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF_DIR}/{name}.parquet", tmp_path / f"{name}.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string"
    rows = [
        (1, None, None, None, None, "x", "y"),
        (2, "", "en", "a", 0, "x", "y"),
        (None, "some words here that are fine", None, "a", 1, None, None),
        (3, "tie tie tie", "en", None, 11, "x", "y"),
        (3, "tie tie tie", "en", None, 11, "x", "y"),
        (4, "many words " * 100_000, "en", "a", None, "x", "y"),
    ]
    frame = spark.createDataFrame(rows, schema)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), frame


def test_every_stage_takes_odd_and_empty_tables(spark, odd):
    sf_dir, docs = odd
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf_dir)
            found = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
                assert len(found) <= rows.count()
            if name == "near_dedup":
                counts = defaultdict(int)
                for r in found:
                    counts[r.doc_id] += 1
                assert not found or counts == {1: 1, 2: 1, None: 1, 3: 1, 4: 1}
