"""Quality classifier: ordinal regression with a cumulative link on hashed text.

A document's features are the presence of its words and of their beginnings, and the
shares of its word shapes and of immediate repetitions, all hashed into one weight vector. Its score f is shared
by all grades; ordered thresholds t_0 < t_1 < ... cut it, P(grade <= j) = s(t_j - f) with
the logistic s. The expected grade and the tail probability P(grade >= g) follow.

The model is fitted in one task on a bounded sample: the ``max_rows`` rated documents with
the least hash of their id (a documented bound, whatever the corpus holds). Whole texts
are used, and every document is scored.

Defined cases: a null text is an empty one, scored by the thresholds alone; ratings that
are null are not used, nor are those with a null id; of several ratings of one id the
least counts; with no rating the thresholds are such that every document is kept. Repeated rows are scored alike. Columns that bear the name of a result
column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.common import (
    ALPHANUMERIC,
    LOWER,
    NOT_BLANK,
    byte_arrays,
    mixed,
    with_computed,
    without,
    word_bounds,
    word_hashes,
)

#: Buckets of the hash, a power of two.
BUCKETS = 1 << 22
#: Buckets that fewer rated documents have get no weight.
LEAST_DOCUMENTS = 5
#: Rated documents that the model is fitted on.
MAX_ROWS = 8_000
#: How many times a share counts as much as the presence of a word.
SHARE_WEIGHT = 8.0
PENALTY = 3e-4
#: Bytes of the word beginnings that count as features besides whole words.
PREFIXES = (4, 6)

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = ord("a")


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of some buckets, in order, and ordered thresholds, one less than grades."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, buckets: np.ndarray, values: np.ndarray) -> float:
        if not self.buckets.size:
            return 0.0
        at = np.minimum(np.searchsorted(self.buckets, buckets), self.buckets.size - 1)
        own = self.buckets[at] == buckets
        return float(np.sum(self.weights[at[own]] * values[own]))

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= j) for each score (row) and threshold (column)."""
        return _logistic(self.thresholds[None, :] - score[:, None])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(kind)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text, each bucket of a word once."""
    starts, ends = word_bounds(text, NOT_BLANK)
    if not starts.size:
        return np.empty(0, np.int64), np.empty(0)
    low = LOWER[text]
    words = word_hashes(low, starts, ends)
    first, last = word_bounds(text, ALPHANUMERIC)  # words without the marks around them
    parts = [_buckets(word_hashes(low, first, last), 1)]
    for kind, size in enumerate(PREFIXES, start=4):
        long = last - first > size
        parts.append(_buckets(word_hashes(low, first[long], first[long] + size), kind))
    present = np.unique(np.concatenate(parts))

    inside = NOT_BLANK[text]
    classes = _SHAPE[text]
    change = inside.copy()
    change[1:] &= (classes[1:] != classes[:-1]) | ~inside[:-1]
    before = np.concatenate([[0], np.cumsum(change)])
    shapes = word_hashes(classes[change], before[starts], before[ends])
    shape, times = np.unique(_buckets(shapes, 2), return_counts=True)
    repeats = np.count_nonzero(words[1:] == words[:-1])
    distinct = np.unique(words).size
    extra = _buckets(np.arange(2, dtype=np.uint64), 3)
    shares = np.concatenate([times, [repeats, distinct]]) * (SHARE_WEIGHT / words.size)
    return (
        np.concatenate([present, shape, extra]),
        np.concatenate([np.ones(present.size), shares]),
    )


def _minimise(fun, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking."""
    value, slope = fun(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, scales = -slope, []
        for s, y in reversed(steps):
            scales.append((s @ direction) / (s @ y))
            direction = direction - scales[-1] * y
        if steps:
            s, y = steps[-1]
            direction = direction * ((s @ y) / (y @ y))
        for (s, y), scale in zip(steps, reversed(scales), strict=True):
            direction = direction + s * (scale - (y @ direction) / (s @ y))
        fall, size = slope @ direction, 1.0 if steps else 1.0 / max(1e-12, np.abs(slope).sum())
        for _ in range(20):
            moved = x + size * direction
            new_value, new_slope = fun(moved)
            if new_value <= value + 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, y = moved - x, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, slope = moved, new_value, new_slope
        if done:
            break
    return x


def fit_ordinal(
    rows: list[tuple[np.ndarray, np.ndarray]],
    grades: np.ndarray,
    count: int,
    penalty: float = PENALTY,
    rounds: int = 60,
) -> OrdinalModel:
    """Maximum likelihood with a squared penalty on the weights, for grades 0 to count - 1."""
    sizes = np.array([b.size for b, _ in rows], np.int64)
    buckets = np.concatenate([b.astype(np.int32) for b, _ in rows])
    values = np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    used, column, documents = np.unique(buckets, return_inverse=True, return_counts=True)
    frequent = documents >= min(LEAST_DOCUMENTS, len(rows))
    keep = frequent[column]
    column = (np.cumsum(frequent) - 1)[column[keep]]
    used, values, owner = used[frequent], values[keep], owner[keep]
    n, d = len(rows), used.size
    top = count - 1
    share = np.array([(grades <= j).mean() for j in range(top)])
    start = np.log((share + 1 / n) / (1 - share + 1 / n))

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gaps = np.exp(x[d + 1 :])
        return x[:d], x[d] + np.concatenate([[0.0], np.cumsum(gaps)])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, cuts = parts(x)
        score = np.bincount(owner, values * weights[column], n)
        s = _logistic(cuts[None, :] - score[:, None])
        padded = np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], axis=1)
        high = padded[np.arange(n), grades + 1]
        low = padded[np.arange(n), grades]
        chance = np.maximum(high - low, 1e-12)
        by_score = (1 - high - low) / n
        slope = np.bincount(column, values * by_score[owner], d) + penalty * weights
        density = s * (1 - s) / chance[:, None] / n
        by_cut = np.array(
            [density[grades == j + 1, j].sum() - density[grades == j, j].sum() for j in range(top)]
        )
        later = np.cumsum(by_cut[::-1])[::-1]
        by_gap = later[1:] * np.exp(x[d + 1 :])
        value = -np.log(chance).mean() + 0.5 * penalty * (weights @ weights)
        return value, np.concatenate([slope, later[:1], by_gap])

    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    x = _minimise(loss, np.concatenate([np.zeros(d), start[:1], gaps]), rounds)
    weights, cuts = parts(x)
    return OrdinalModel(used, weights, cuts)


def fit_quality(
    docs: DataFrame,
    ratings: DataFrame,
    grades: int,
    doc_id: str = "doc_id",
    text: str = "text",
    grade: str = "grade",
    max_rows: int = MAX_ROWS,
) -> OrdinalModel:
    """Fit on the sampled ratings (doc_id, grade from 0); runs when called."""
    rated = ratings.select(F.col(f"`{doc_id}`").alias("r_id"), F.col(f"`{grade}`").cast("int").alias("grade"))
    rated = rated.where(f"r_id is not null and grade between 0 and {grades - 1}")
    rated = rated.groupBy("r_id").agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("r_id"), "r_id").limit(max_rows)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    # the sample is bounded by max_rows, so that the texts need no shuffle
    found = texts.join(F.broadcast(sample), texts["id"] == sample["r_id"])

    def compute(column: pa.Array) -> list[list]:
        rows = [features(x if x is not None else np.empty(0, np.uint8)) for x in byte_arrays(column)]
        return [[b.astype("<i4").tobytes() for b, _ in rows], [v.astype("<f4").tobytes() for _, v in rows]]

    made = with_computed(found, ["text"], "buckets binary, vals binary", compute)
    made = made.dropDuplicates(["id"]).select("grade", "buckets", "vals")

    def fit(all_rows: pa.Table) -> pa.Table:
        rows = [
            (np.frombuffer(b, "<i4"), np.frombuffer(v, "<f4"))
            for b, v in zip(
                all_rows.column("buckets").to_pylist(), all_rows.column("vals").to_pylist(), strict=True
            )
        ]
        model = fit_ordinal(rows, all_rows.column("grade").to_numpy(), grades)
        return pa.table(
            {
                "buckets": pa.array([model.buckets.astype("<i4").tobytes()], pa.binary()),
                "weights": pa.array([model.weights.astype("<f8").tobytes()], pa.binary()),
                "thresholds": pa.array([model.thresholds.tolist()], pa.list_(pa.float64())),
            }
        )

    one = made.groupBy(F.lit(0).alias("all")).applyInArrow(
        fit, "buckets binary, weights binary, thresholds array<double>"
    )
    row = one.first()
    if row is None:
        none = np.empty(0)
        return OrdinalModel(none.astype(np.int64), none, np.arange(grades - 1) - float(grades - 1))
    return OrdinalModel(
        np.frombuffer(row["buckets"], "<i4").astype(np.int64),
        np.frombuffer(row["weights"], "<f8"),
        np.array(row["thresholds"]),
    )


def score_quality(docs: DataFrame, model: OrdinalModel, tail: int, text: str = "text") -> DataFrame:
    """The rows with expected_grade and tail_probability, P(grade >= tail)."""

    def compute(column: pa.Array) -> list[list]:
        scores = []
        for data in byte_arrays(column):
            buckets, values = features(data) if data is not None else (np.empty(0, np.int64), np.empty(0))
            scores.append(model.score(buckets, values))
        below = model.below(np.array(scores, float))
        expected = model.thresholds.size - below.sum(axis=1)
        return [expected.tolist(), (1 - below[:, tail - 1]).tolist()]

    return with_computed(docs, [text], "expected_grade double, tail_probability double", compute)


def classify_quality(
    docs: DataFrame,
    ratings: DataFrame,
    grades: int = 3,
    tail: int = 2,
    least: float = 0.5,
    training_docs: DataFrame | None = None,
    **options,
) -> DataFrame:
    """The rows with expected_grade, tail_probability and kept (tail_probability >= least).

    ``training_docs`` holds the texts of the rated documents where ``docs`` may not.
    """
    text = options.get("text", "text")
    model = fit_quality(docs if training_docs is None else training_docs, ratings, grades, **options)
    scored = score_quality(without(docs, "kept"), model, tail, text)
    return scored.withColumn("kept", F.col("tail_probability") >= least)
