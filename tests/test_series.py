"""Time series, ranking, windows and events against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from freightlens.functions import day
from freightlens.operators import (
    capacity_windows,
    lag_features,
    lead_corr,
    next_event_after,
    rolling_rows_mean,
    seasonal_forecast,
    top_ranked,
    transition_events,
)
from freightlens.plans import analyses


def test_lags_count_rows_not_days(spark):
    rows = [
        (date(2024, 1, 1), 1.0, 10.0),
        (date(2024, 1, 5), 1.0, None),
        (date(2024, 1, 6), 1.0, 30.0),
        (date(2024, 1, 9), 1.0, 40.0),
        (date(2024, 1, 9), 2.0, 50.0),
    ]
    df = spark.createDataFrame(rows, "dt date, route double, v double")
    got = lag_features(df, "route", "dt", {"v_lag": "v"})
    assert sorted(map(tuple, got.collect()), key=str) == [
        (date(2024, 1, 5), 1.0, None, 10.0),
        (date(2024, 1, 9), 1.0, 40.0, 30.0),
    ]


def test_forecast_with_a_missing_day(spark):
    days = [date(2024, 1, 1) + timedelta(d) for d in range(12) if d != 4]
    totals = {d: float(10 + i * i) for i, d in enumerate(days)}
    rows = [(datetime(d.year, d.month, d.day, h), t / 2) for d, t in totals.items() for h in (1, 5)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    got = seasonal_forecast(df, day("t"), "v", last_week=3, last_year=9, rows=4).collect()
    assert [r["dt"] for r in got] == days[:-5:-1]
    for r in got:
        i = days.index(r["dt"])
        same = [t for d, t in totals.items() if d.weekday() == r["dt"].weekday()]
        week, year = totals[days[i - 3]], totals[days[i - 9]] if i >= 9 else None
        assert r["demand_last_week"] == week
        assert r["demand_last_year"] == year
        weekday = sum(same) / len(same)
        assert r["avg_weekday_demand"] == pytest.approx(weekday, abs=0.005)
        want = None if year is None else pytest.approx((weekday + week + year) / 3, abs=0.005001)
        assert r["forecast_for_next_day"] == want


def test_rolling_mean_counts_rows_over_month_gaps(spark):
    rows = [(2023, 11, 1.0), (2023, 12, 2.0), (2024, 3, 6.0), (2024, 10, 3.0)]
    df = spark.createDataFrame(rows, "yr int, mth int, v double")
    got = rolling_rows_mean(df, ["yr", "mth"], "v", "m", 3, 1).orderBy("yr", "mth").collect()
    assert [r["m"] for r in got] == [1.0, 1.5, 3.0, 3.7]


def test_lead_correlation_by_hand(spark):
    rng = random.Random(2)
    series = [(date(2024, 1, 1) + timedelta(i), rng.random(), rng.random()) for i in range(40)]
    df = spark.createDataFrame(series, "d date, x double, y double")
    got = lead_corr(df, F.col("d"), F.col("x"), F.col("y")).first()
    x, y = [s[1] for s in series], [s[2] for s in series]
    nxt = x[1:]

    def mean(v):
        return sum(v) / len(v)

    def spread(v):
        return sum((e - mean(v)) ** 2 for e in v)

    same = sum((a - mean(x)) * (b - mean(y)) for a, b in zip(x, y))
    lead = sum((a - mean(nxt)) * (b - mean(y)) for a, b in zip(nxt, y))
    assert got["corr_same_day"] == pytest.approx(same / (spread(x) * spread(y)) ** 0.5, abs=5.1e-5)
    assert got["corr_lag1_day"] == pytest.approx(lead / (spread(nxt) * spread(y)) ** 0.5, abs=5.1e-5)


def test_top_ranked_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 3)], "k string, v int")
    got = top_ranked(df, ["v"], 2, "rank")
    assert [(r["k"], r["rank"]) for r in got.orderBy("k").collect()] == [("a", 1), ("b", 2), ("c", 2)]


@pytest.mark.parametrize("capacity", [1, 3, 10])
def test_capacity_windows(spark, capacity):
    """One group holds most rows; groups and values include NULL."""
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        group = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", None])
        rows.append((i, group, rng.randrange(3), rng.choice([None, float(rng.randrange(40))])))
    df = spark.createDataFrame(rows, "id bigint, g string, b int, v double").repartition(7)
    got = capacity_windows(df, ["g", "b"], "v", "id", capacity, "w", "n", "m").collect()
    groups = defaultdict(list)
    for i, g, b, v in rows:
        groups[g, b].append((v is None, -(v or 0), i, v))
    want = {}
    for (g, b), members in groups.items():
        members.sort()
        for start in range(0, len(members), capacity):
            values = [m[3] for m in members[start : start + capacity]]
            present = [v for v in values if v is not None]
            mean = sum(present) / len(present) if present else None
            want[g, b, start // capacity + 1] = (len(values), mean)
    assert sum(r["n"] for r in got) == len(rows)
    assert {(r["g"], r["b"], r["w"]): r["n"] for r in got} == {k: v[0] for k, v in want.items()}
    for r in got:
        mean = want[r["g"], r["b"], r["w"]][1]
        assert r["m"] == (None if mean is None else pytest.approx(mean, abs=0.00501))


def _naive_changes(rows):
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    return {
        (b[0], a[2], b[2])
        for a, b in zip(ordered, ordered[1:])
        if a[2] is not None and b[2] is not None and a[2] != b[2]
    }


def _naive_spans(changes):
    starts = {t for t, before, state in changes if (before, state) == (1, 0)}
    ends = sorted(t for t, before, state in changes if (before, state) == (0, 1))
    found = {s: next((e for e in ends if e > s), None) for s in starts}
    return {(s, e) for s, e in found.items() if e is not None}


EPOCH = datetime(2024, 1, 1)
SERIES = {
    "starts down": [(EPOCH, 1, 0), (EPOCH + timedelta(hours=1), 2, 1)],
    "never comes back": [(EPOCH, 1, 1), (EPOCH + timedelta(hours=1), 2, 0)],
    "through unknown": [
        (EPOCH + timedelta(hours=i), i, s) for i, s in enumerate([1, None, 0, 1, 0, None, 1, 0, 1])
    ],
    "one moment": [(EPOCH, i, i % 2) for i in range(30)],
    "two moments": [(EPOCH + timedelta(minutes=i // 15), i, i % 2) for i in range(30)],
    "empty": [],
}


def _random_series(n, minutes, seed):
    rng = random.Random(seed)
    return [
        (
            EPOCH + timedelta(minutes=rng.randrange(minutes)),
            i,
            rng.choices([1, 0, None], [8, 2, 1])[0],
        )
        for i in range(n)
    ]


SERIES["random"] = _random_series(2000, 20_000, 1)
SERIES["colliding times"] = _random_series(2000, 60, 2)


@pytest.mark.parametrize("case", SERIES)
@pytest.mark.parametrize("ranges", [1, 8])
def test_downtime_spans(spark, case, ranges):
    rows = SERIES[case]
    df = spark.createDataFrame(rows, "t timestamp_ntz, id bigint, s int").repartition(3)
    changes = transition_events(df, "t", "id", "s", ranges)
    got = {(r["at"], r["prev_state"], r["state"]) for r in changes.collect()}
    down = (F.col("prev_state") == 1) & (F.col("state") == 0)
    back = (F.col("prev_state") == 0) & (F.col("state") == 1)
    spans = next_event_after(changes, down, back).collect()
    want = _naive_changes(rows)
    assert got == want
    assert len(spans) == len(set(spans))
    assert {tuple(r) for r in spans} == _naive_spans(want)


def test_monthly_downtime_skips_quiet_months(spark):
    def at(month, hour, minute=0):
        return datetime(2024, month, 1, hour, minute)

    moments = [
        (at(1, 0), 1),
        (at(1, 1), 0),
        (at(1, 3, 59), 1),  # 2 h 59 min counts as 2
        (at(4, 0), 0),
        (at(4, 5), 1),
        (at(4, 6), 0),  # never comes back
    ]
    rows = [(i, t, s) for i, (t, s) in enumerate(moments)]
    df = spark.createDataFrame(
        rows, "shipment_id bigint, timestamp timestamp_ntz, handling_equipment_availability int"
    )
    got = [tuple(r) for r in analyses.equipment_downtime(df).collect()]
    assert got == [(2024, 1, 2.0, 1, 2.0), (2024, 4, 5.0, 1, 3.5)]
