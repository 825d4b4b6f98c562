from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.llm.common import table
from freightlens.llm.quality import classify_quality, features, fit_ordinal, fit_quality
from freightlens.llm.queries import graded_labels, op10_ordinal_quality


def encoded(text):
    return features(np.frombuffer(text.encode(), np.uint8))


def test_graded_words():
    rng = np.random.default_rng(0)
    words = {0: "awful", 1: "plain", 2: "good"}
    grades = rng.integers(0, 3, 300)
    rows = [encoded(f"{words[g]} w{rng.integers(5)} v{rng.integers(5)}") for g in grades]
    model = fit_ordinal(rows, grades, 3)
    assert (np.diff(model.thresholds) > 0).all()
    scores = np.array([model.score(*r) for r in rows])
    below = model.below(scores)
    assert ((below < 0.5).sum(axis=1) == grades).all()
    assert (np.diff(below, axis=1) >= 0).all()


def test_slopes_match_differences():
    """The fit ends where small moves of any parameter raise the loss."""
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 200)
    rows = [encoded(" ".join(f"w{rng.integers(12)}" for _ in range(4 + g))) for g in grades]
    model = fit_ordinal(rows, grades, 4, penalty=1e-2, rounds=400)

    def loss(weights, cuts):
        total = 0.0
        place = {int(b): k for k, b in enumerate(model.buckets)}
        for (buckets, values), grade in zip(rows, grades):
            score = sum(weights[place[int(b)]] * v for b, v in zip(buckets, values) if int(b) in place)
            chance = [0.0, *(1 / (1 + np.exp(score - cuts))), 1.0]
            total -= np.log(chance[grade + 1] - chance[grade])
        return total / len(rows) + 0.5 * 1e-2 * (weights @ weights)

    best = loss(model.weights, model.thresholds)
    for k in range(3):
        for step in (-0.05, 0.05):
            moved = model.thresholds.copy()
            moved[k] += step
            assert loss(model.weights, moved) > best - 1e-5
    for k in range(0, model.weights.size, 5):
        for step in (-0.05, 0.05):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved, model.thresholds) > best - 1e-5


def test_edge_cases(spark, docs_of):
    rows = [(k, "fine words here" if k % 2 else "bad words here") for k in range(40)]
    rows += [(100, None), (101, ""), (102, "x " * 50_000), (None, "fine words"), (1, "fine words here")]
    docs = docs_of(rows, ("Kept", "grade", "expected_grade"))
    ratings = spark.createDataFrame(
        [(k, k % 2, "x") for k in range(40)] + [(None, 1, "x"), (3, None, "x"), (999, 1, "x"), (5, 1, "x")],
        "doc_id long, grade int, text string",
    )
    got = classify_quality(docs, ratings, grades=2, tail=1).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows) and all(kept[k] == bool(k % 2) for k in range(40))
    assert all(0 <= r.expected_grade <= 1 and 0 <= r.tail_probability <= 1 for r in got)
    assert {r.tail_probability for r in got if r.doc_id in (100, 101)}.__len__() == 1


def test_empty_tables(spark, docs_of):
    ratings = spark.createDataFrame([], "doc_id long, grade int")
    assert all(r.kept for r in classify_quality(docs_of([(1, "a"), (2, None)]), ratings).collect())
    assert classify_quality(docs_of([]), ratings).count() == 0


def test_the_sample_is_bounded(spark, docs_of):
    docs = docs_of([(k, f"w{k % 3}") for k in range(50)])
    ratings = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, grade int")
    few = fit_quality(docs, ratings, 2, max_rows=10)
    again = fit_quality(docs.repartition(3), ratings.repartition(2), 2, max_rows=10)
    assert np.allclose(few.thresholds, again.thresholds, atol=1e-3)


def test_held_out_accuracy(spark):
    """Trained on four fifths of the ratings, some 3,200, tested on the rest."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf_dir, "documents"), graded_labels(spark, sf_dir)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5))
    judged = classify_quality(docs, labels.where(fold != 0)).select("doc_id", "kept")
    rows = judged.join(labels.where(fold == 0), "doc_id").collect()
    share = {g: np.mean([r.kept for r in rows if r.grade == g]) for g in range(3)}
    assert share[2] > 0.98 and share[1] < 0.15 and share[0] < 0.2


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_query(spark, sf_dir):
    got = op10_ordinal_quality(spark, sf_dir)
    assert got.columns == ["doc_id", "expected_grade", "tail_probability", "kept"]
    assert got.count() == table(spark, sf_dir, "documents").count()
