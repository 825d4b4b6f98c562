from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from freightlens.functions import day, hour_of_day
from freightlens.operators import (
    bin_column,
    cross_profile,
    excursion_association,
    feature_set,
    group_profile,
    iqr_outliers,
    label_rank,
    mean_of_period_means,
    period_union,
    quality_profile,
    share_where,
    sigma_excursions,
    value_summary,
)
from freightlens.plans import analyses as a


def _values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_cut_points_belong_to_the_upper_bin(spark):
    rows = [(0.329,), (0.33,), (0.659,), (0.66,), (5.0,), (None,)]
    df = spark.createDataFrame(rows, "p double")
    got = df.select(bin_column(F.col("p"), a.PORT_CUTS, a.PORT_BINS)).collect()
    assert [r[0] for r in got] == ["low", "medium", "medium", "high", "high", "high"]


def test_risk_and_hour_bins(spark):
    rows = [(2.9, 0), (3.0, 5), (5.9, 6), (6.0, 11), (7.9, 12), (8.0, 17), (10.0, 18), (None, None)]
    df = spark.createDataFrame(rows, "r double, h int")
    got = _values(
        df.select(
            bin_column(F.col("r"), a.RISK_CUTS, a.RISK_BUCKETS).alias("r"),
            bin_column(F.col("h"), a.HOUR_CUTS, a.DAY_PARTS).alias("h"),
        ),
        "r",
        "h",
    )
    assert got == [
        ("Low", "Night"),
        ("Moderate", "Night"),
        ("Moderate", "Morning"),
        ("High", "Morning"),
        ("High", "Afternoon"),
        ("Severe", "Afternoon"),
        ("Severe", "Evening"),
        ("Severe", "Evening"),
    ]


def test_bins_need_matching_labels(spark):
    with pytest.raises(ValueError):
        bin_column(F.lit(1), (1, 2), ("a", "b"))


def test_bins_sort_by_meaning(spark):
    df = spark.createDataFrame([("high",), ("low",), ("medium",)], "b string")
    got = df.orderBy(label_rank(F.col("b"), a.PORT_BINS)).collect()
    assert [r[0] for r in got] == ["low", "medium", "high"]


def test_group_profile_keeps_the_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0)], "k string, v double")
    got = group_profile(df, {"k": F.col("k")}, {"m": F.avg("v"), "n": F.count("*")}, {"m": 1})
    assert sorted(_values(got, "k", "m", "n"), key=str) == [("a", 1.5, 2), (None, 5.0, 1)]


def test_cross_profile_pairs_all_groups(spark):
    rows = [
        (datetime(2024, 1, 1, 1), 0.0, 10.0),
        (datetime(2024, 1, 2, 1), 1.0, 20.0),
        (datetime(2024, 1, 1, 2), 1.0, None),
        (datetime(2024, 1, 1, 3), 2.0, 40.0),
    ]
    df = spark.createDataFrame(rows, "t timestamp_ntz, level double, fuel double")
    got = cross_profile(
        df, ("h", hour_of_day("t")), ("level", F.col("level")), "fuel", ("by_h", "by_level")
    )
    hours = {1: 15.0, 2: None, 3: 40.0}
    levels = {0.0: 10.0, 1.0: 20.0, 2.0: 40.0}
    want = {(h, x, level, y) for h, x in hours.items() for level, y in levels.items()}
    assert set(map(tuple, got.collect())) == want
    assert got.count() == 9


def test_period_union_stacks_text_periods(spark):
    rows = [
        (datetime(2024, 1, 1, 9), 1.0),
        (datetime(2024, 1, 1, 10), 3.0),
        (datetime(2024, 1, 2, 9), 5.0),
        (None, 7.0),
    ]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    got = period_union(df, {"daily": day("t"), "hourly": hour_of_day("t")}, "v", "x")
    assert dict(got.dtypes)["period_value"] == "string"
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [
            ("daily", "2024-01-01", 2.0, 1.0, 3.0),
            ("daily", "2024-01-02", 5.0, 5.0, 5.0),
            ("daily", None, 7.0, 7.0, 7.0),
            ("hourly", "9", 3.0, 1.0, 5.0),
            ("hourly", "10", 3.0, 3.0, 3.0),
            ("hourly", None, 7.0, 7.0, 7.0),
        ],
        key=str,
    )


def test_share_where(spark):
    df = spark.createDataFrame([(7.0,), (6.9,), (None,)], "r double")
    assert share_where(df, F.col("r") >= 7, "p").first()["p"] == 33.33
    assert share_where(df.limit(0), F.col("r") >= 7, "p").first()["p"] is None


def test_mean_of_period_means_is_not_the_overall_mean(spark):
    rows = [(1, "x", 10.0), (1, "x", 10.0), (1, "x", 10.0), (2, "x", 0.0)]
    df = spark.createDataFrame(rows, "d int, k string, v double")
    got = mean_of_period_means(df, F.col("d"), "k", {"m": ("v", 2)})
    assert _values(got, "k", "m") == [("x", 5.0)]


def test_sigma_thresholds_differ(spark):
    """One point lies between mean + 2 sigma and mean + 3 sigma, one above both."""
    temps = [0.0] * 100 + [7.0, 26.0]
    rows = [(float(t), 1.0 if t else 0.0, 8.0) for t in temps]
    df = spark.createDataFrame(rows, "t double, cargo double, risk double")
    mean = sum(temps) / len(temps)
    sigma = (sum((t - mean) ** 2 for t in temps) / len(temps)) ** 0.5
    assert mean + 2 * sigma < 7 < mean + 3 * sigma < 26
    above = {k: sigma_excursions(df, "t", k).count() for k in (2, 3)}
    want = {k: sum(t > mean + k * sigma for t in temps) for k in (2, 3)}
    assert above == want == {2: 2, 3: 1}
    got = excursion_association(
        df, "t", "cargo", {"risky": F.col("risk") >= 7}, "hot", "mean_cargo", k=2
    )
    assert list(map(tuple, got.collect())) == [(1, 1, 1.0), (0, 1, 0.0)]


def test_iqr_outliers_upper_side_only(spark):
    values = [-500.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 500.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = iqr_outliers(df, "v")
    # ranks ceil(2.5) = 3 and ceil(7.5) = 8 of the sorted values
    assert _values(got, "v", "bound") == [(500.0, (7.0 - 2.0) * 1.5)]


def test_value_summary(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 7)], "v double")
    got = value_summary(df, "v", "t").first().asDict()
    assert got == {"t_mean": 3.5, "t_std": 1.71, "t_q1": 2.0, "t_median": 3.0, "t_q3": 4.0}
    assert value_summary(df.limit(0), "v", "t").collect() == []


def test_quality_profile(spark):
    df = spark.createDataFrame(
        [(1.0, None, "x"), (1.0, None, "y"), (None, None, "x"), (1.0, None, None)],
        "a double, b int, c string",
    )
    columns = {c: (f"null_{c}", f"var_{c}") for c in "abc"}
    assert quality_profile(df, columns).first().asDict() == {
        "total_rows": 4,
        "null_a": 25.0,
        "var_a": "CONSTANT",
        "null_b": 100.0,
        "var_b": "VARIED",
        "null_c": 25.0,
        "var_c": "VARIED",
    }
    empty = quality_profile(df.limit(0), columns).first()
    assert (empty["total_rows"], empty["null_a"], empty["var_a"]) == (0, None, "VARIED")


def test_feature_set_keeps_rows_and_order(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "a int, b double")
    got = feature_set(df, ["b", "twice", "a"], {"twice": F.col("a") * 2})
    assert got.columns == ["b", "twice", "a"]
    assert sorted(map(tuple, got.collect()), key=str) == [(3.0, 4, 2), (None, 2, 1)]
