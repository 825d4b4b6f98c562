from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from freightlens.functions import (
    pearson_centred,
    pearson_moments,
    pearson_pairwise,
    round_half_up,
    share,
    weekday_from_zero,
    whole_hours,
)


def test_round_half_up(spark):
    values = [0.285, 2.5, -0.285, 1e25, float("nan"), None, 1.0000000000004]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["r"] for r in df.select("i", round_half_up(F.col("v"), 2).alias("r")).orderBy("i").collect()]
    assert got[:4] == [0.29, 2.5, -0.29, 1e25]
    assert math.isnan(got[4])
    assert got[5:] == [None, 1.0]


def _python_r(rows, variant):
    """The three definitions written out over Python lists."""
    xs = [x for x, _ in rows if x is not None]
    ys = [y for _, y in rows if y is not None]
    both = [(x, y) for x, y in rows if x is not None and y is not None]

    def mean(values):
        return sum(values) / len(values)

    def var(values):
        return mean([v * v for v in values]) - mean(values) ** 2

    if variant == "pairwise":
        xs, ys = [x for x, _ in both], [y for _, y in both]
    if variant == "centred":
        mx, my = mean(xs), mean(ys)
        top = sum((x - mx) * (y - my) for x, y in both)
        return top / math.sqrt(sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys))
    top = mean([x * y for x, y in both]) - mean(xs) * mean(ys)
    return top / math.sqrt(var(xs) * var(ys))


_R = {"moments": pearson_moments, "centred": pearson_centred, "pairwise": pearson_pairwise}


@pytest.mark.parametrize("variant", _R)
def test_pearson_with_nulls(spark, variant):
    rows = [(1.0, 2.0), (2.0, None), (None, 9.0), (4.0, 3.0), (7.0, -1.0), (5.0, 2.5)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = df.agg(_R[variant](F.col("x"), F.col("y")).alias("r")).first()["r"]
    assert got == pytest.approx(_python_r(rows, variant), abs=1e-12)


def test_pearson_variants_agree_without_nulls(spark):
    rows = [(float(i % 7), float(i * i % 11)) for i in range(50)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = df.agg(*(r(F.col("x"), F.col("y")).alias(n) for n, r in _R.items())).first()
    assert got["moments"] == pytest.approx(got["pairwise"], abs=1e-12)
    assert got["centred"] == pytest.approx(got["pairwise"], abs=1e-12)
    assert -1 <= got["pairwise"] <= 1


@pytest.mark.parametrize("value", [0.1, 1 / 3, 1000000000.1])
def test_pearson_of_a_constant_column_is_null(spark, value):
    """Whatever the computed deviation of the constant is over several partitions."""
    df = spark.range(1000, numPartitions=7).select(
        F.lit(value).alias("x"), (F.col("id") * 0.7).alias("y")
    )
    for pair in (("x", "y"), ("y", "x")):
        got = df.agg(*(r(*map(F.col, pair)).alias(n) for n, r in _R.items())).first()
        assert list(got) == [None, None, None]


def test_rounding_happens_once(spark):
    """In Spark and in the statements it is checked against."""
    import duckdb

    from freightlens.oracle.duckdb_sql import r

    for value, want in [
        (0.12344999999999999, 0.1234), (0.12344999996, 0.1234), (0.00004999999999999, 0.0),
        (0.285, 0.285), (1e-7, 0.0), (1e25, 1e25), (-0.00005, -0.0001), (123456.00005, 123456.0001),
    ]:
        df = spark.createDataFrame([(value,)], "v double")
        assert df.select(round_half_up(F.col("v"), 4)).first()[0] == want
        assert duckdb.sql(f"SELECT {r(f'CAST({value!r} AS DOUBLE)', 4)}").fetchall()[0][0] == want


@pytest.mark.parametrize(
    "rows",
    [[(1.0, 2.0), (1.0, 5.0)], [(1.0, 2.0)], [(1.0, None), (None, 2.0)], []],
    ids=["constant x", "one row", "no pair", "empty"],
)
def test_pearson_without_variance_is_null(spark, rows):
    df = spark.createDataFrame(rows, "x double, y double")
    got = df.agg(*(r(F.col("x"), F.col("y")).alias(n) for n, r in _R.items())).first()
    assert list(got) == [None, None, None]


def test_share_counts_null_as_no(spark):
    df = spark.createDataFrame([(1,), (5,), (None,), (9,)], "v int")
    assert df.agg(share(F.col("v") > 4).alias("s")).first()["s"] == 0.5


def test_weekday_starts_on_sunday(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 7),), (datetime(2024, 1, 13),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(weekday_from_zero("t")).collect()] == [0, 6]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_whole_hours_ignores_session_zone(spark, zone):
    spans = [
        (datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 2, 59, 59), 2),
        (datetime(2024, 1, 1, 0, 59), datetime(2024, 1, 1, 1, 0), 0),
        # across a clock change in New York
        (datetime(2024, 3, 10, 0), datetime(2024, 3, 10, 5), 5),
        (datetime(2024, 1, 30, 23), datetime(2024, 2, 2, 1), 50),
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(spans, "a timestamp_ntz, b timestamp_ntz, want int")
        got = df.select(whole_hours(F.col("a"), F.col("b")).alias("h"), "want").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r["h"] for r in got] == [r["want"] for r in got]
