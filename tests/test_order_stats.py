"""Quantiles and NTILE against plain Python, with one and with several rounds of searching."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from freightlens.operators import exact_ntile, group_quantiles, order_stats, row_search


@pytest.fixture(params=["one round", "several rounds", "coarse sample"])
def path(request, monkeypatch):
    """As usual; narrowing on and on; brackets that are too narrow, so that ranks are missed."""
    if request.param == "several rounds":
        monkeypatch.setattr(order_stats, "CELLS", 2)
        monkeypatch.setattr(row_search, "CELLS", 40)
        monkeypatch.setattr(row_search, "SAMPLE", 200)
    if request.param == "coarse sample":
        monkeypatch.setattr(row_search, "CELLS", 40)
        monkeypatch.setattr(row_search, "SAMPLE", 30)
        monkeypatch.setattr(row_search, "MARGIN", 0.05)
    return request.param


FRACTIONS = {"a": "0.1", "b": "0.25", "c": "0.50", "d": "0.75"}
RULES = {
    "ceil": lambda n, tenths: -(-n * tenths // 100),
    "floor": lambda n, tenths: (n - 1) * tenths // 100 + 1,
}


def _expected(values, rule):
    ordered = sorted(values, key=lambda v: (v is not None, v))
    return tuple(
        ordered[max(RULES[rule](len(ordered), p), 1) - 1] for p in (10, 25, 50, 75)
    )


@pytest.mark.parametrize("rule", RULES)
def test_quantiles_per_group(spark, path, rule):
    """Group sizes 1..21 cover every remainder where the rules differ."""
    rng = random.Random(7)
    groups = {n: [float(rng.randrange(12)) for _ in range(n)] for n in range(1, 22)}
    groups[None] = [None, None, 3.0, 1.0, None, 2.0, 2.0]
    rows = [(g, v) for g, values in groups.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    got = {r["g"]: tuple(r)[1:] for r in group_quantiles(df, "x", FRACTIONS, rule, ["g"]).collect()}
    assert got == {g: _expected(v, rule) for g, v in groups.items()}


def test_rules_differ_where_expected(spark):
    rows = [(n, float(i)) for n in range(1, 22) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, x double")
    both = {}
    for rule in RULES:
        found = group_quantiles(df, "x", {"q": "0.75"}, rule, ["g"]).collect()
        both[rule] = {r["g"]: r["q"] for r in found}
    differ = {n for n in both["ceil"] if both["ceil"][n] != both["floor"][n]}
    assert differ == {n for n in range(1, 22) if n % 4 in (2, 3)}


def test_global_quantiles_with_hot_value(spark, path):
    rng = random.Random(3)
    values = [5.0] * 700 + [rng.uniform(0, 100) for _ in range(1300)] + [None] * 40
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(6)
    got = group_quantiles(df, "x", FRACTIONS, "ceil").first()
    assert tuple(got) == _expected(values, "ceil")


def test_empty_input_has_no_quantiles(spark, path):
    df = spark.createDataFrame([], "x double")
    assert group_quantiles(df, "x", FRACTIONS, "ceil").collect() == []


def test_a_missed_rank_is_looked_for_again(spark, monkeypatch):
    """Brackets that miss a rank are widened until the answer is exact."""
    margins, whole = [], row_search._search

    def search(df, order, count, ranks, margin, sample):
        found = whole(df, order, count, ranks, margin, sample)
        margins.append((margin, found is None))
        return found

    monkeypatch.setattr(row_search, "_search", search)
    monkeypatch.setattr(row_search, "MARGIN", -30.0)  # every bracket lies beside its rank
    monkeypatch.setattr(row_search, "CELLS", 300)
    monkeypatch.setattr(row_search, "SAMPLE", 100)
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert tuple(group_quantiles(df, "x", FRACTIONS, "ceil").first()) == (100.0, 250.0, 500.0, 750.0)
    assert margins[0] == (-30.0, True) and margins[-1][1] is False


def test_large_tables_need_two_passes(spark, monkeypatch):
    """All cuts of a hundred thousand rows, also inside runs of equal keys."""
    passes, whole = [], row_search._counted

    def counted(df, order, brackets, fraction, seed):
        zones = whole(df, order, brackets, fraction, seed)
        passes.append(sum(zones.sample(2 * k + 1).distinct for k in range(len(brackets))))
        return zones

    monkeypatch.setattr(row_search, "_counted", counted)
    df = spark.range(100_000).select("id", (F.col("id") * 7 % 101).cast("double").alias("k"))
    naive = F.ntile(10).over(Window.orderBy("k", "id"))
    tiled = exact_ntile(df, "tile", 10, "k", "id").withColumn("want", naive)
    assert tiled.where("tile <> want").isEmpty()
    assert len(passes) == 2 and max(passes) <= row_search.CELLS


def test_equal_values_end_the_search(spark, monkeypatch):
    """A value that holds most rows is not looked into, however many rows there are."""
    monkeypatch.setattr(row_search, "CELLS", 100)
    monkeypatch.setattr(row_search, "SAMPLE", 50)
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-5).alias("x"))
    assert row_search.rows_at_ranks(df, ["x"], lambda n: {"a": 1, "b": 9000, "c": n, "d": n + 1}) == {
        "a": (-5,), "b": (-5,), "c": (19_998,),
    }


def test_codes_order_like_doubles(spark):
    rng = random.Random(4)
    values = [0.0, 5e-324, -5e-324, 2.0**-1022, 1.0, -1.0, 1.7e308, -1.7e308, float("inf"), -float("inf")]
    values += [rng.choice((1, -1)) * rng.random() * 2.0 ** rng.randint(-1070, 1020) for _ in range(500)]
    values += [f * 2.0**e for e in range(-1060, 1020, 7) for f in (1.0, 1 - 2.0**-53, 1 + 2.0**-52)]
    df = spark.createDataFrame([(v,) for v in values] + [(float("nan"),), (None,)], "x double")
    rows = df.select("x", order_stats.ordered_code(F.col("x")).alias("c")).collect()
    by_code = sorted(rows, key=lambda r: r.c)
    assert by_code[0].x is None and by_code[-1].x != by_code[-1].x
    ordered = by_code[1:-1]
    assert [r.x for r in ordered] == sorted(values)
    assert all((a.c == b.c) == (a.x == b.x) for a, b in zip(ordered, ordered[1:]))


def test_many_groups(spark):
    """One row for each rank is kept of a group, no sketch."""
    df = spark.range(200_000).select((F.col("id") % 10_000).alias("g"), (F.col("id") * 7919 % 100_003).cast("double").alias("x"))
    got = group_quantiles(df, "x", {"a": "0.25", "b": "0.75"}, "ceil", ["g"])
    place = Window.partitionBy("g").orderBy("x")
    want = df.withColumn("r", F.row_number().over(place)).groupBy("g").agg(
        F.max(F.when(F.col("r") == 5, F.col("x"))).alias("a"), F.max(F.when(F.col("r") == 15, F.col("x"))).alias("b")
    )
    assert got.count() == 10_000 and got.exceptAll(want).isEmpty()


@pytest.mark.parametrize(
    "kind, make",
    [
        ("string", lambda k: F.concat(F.lit("é"), F.lpad(k.cast("string"), 9, "0"))),
        ("date", lambda k: F.date_add(F.lit("1950-01-01").cast("date"), k.cast("int"))),
        ("timestamp_ntz", lambda k: F.make_timestamp_ntz(F.lit(1960), F.lit(1), F.lit(1), F.lit(0), F.lit(0), k / 20)),
        ("decimal(20,3)", lambda k: (k - 500).cast("decimal(20,3)")),
    ],
)
def test_other_types_rank_too(spark, path, kind, make):
    df = spark.range(1000).select(make(F.col("id")).cast(kind).alias("x"), F.col("id").alias("k"))
    got = group_quantiles(df, "x", FRACTIONS, "ceil").first()
    want = {r["k"]: r["x"] for r in df.collect()}
    assert tuple(got) == tuple(want[k] for k in (99, 249, 499, 749))
    grouped = group_quantiles(df.withColumn("g", F.lit("all")), "x", FRACTIONS, "ceil", ["g"]).first()
    assert tuple(grouped)[1:] == tuple(got)


NTILE_CASES = {
    "fewer rows than tiles": (7, 10, lambda rng: float(rng.randrange(5))),
    "uneven": (1003, 5, lambda rng: rng.random()),
    "heavy ties": (2000, 4, lambda rng: float(rng.randrange(3))),
    "null keys": (1500, 10, lambda rng: None if rng.random() < 0.3 else rng.random()),
    "hot key": (3000, 10, lambda rng: 0.5 if rng.random() < 0.4 else rng.random()),
    "one value": (50, 4, lambda rng: 1.0),
    "one tile": (20, 1, lambda rng: rng.random()),
}


@pytest.mark.parametrize("case", NTILE_CASES)
def test_ntile_equals_window(spark, path, case):
    n, tiles, make = NTILE_CASES[case]
    rng = random.Random(11)
    rows = [(i, make(rng)) for i in rng.sample(range(10 * n), n)]
    df = spark.createDataFrame(rows, "id bigint, k double").repartition(4)
    naive = F.ntile(tiles).over(Window.orderBy("k", "id"))
    got = exact_ntile(df, "tile", tiles, "k", "id").withColumn("want", naive).collect()
    assert len(got) == n
    assert [r for r in got if r["tile"] != r["want"]] == []
    sizes = [sum(r["tile"] == t for r in got) for t in {r["tile"] for r in got}]
    assert max(sizes) - min(sizes) <= 1
    assert max(r["tile"] for r in got) == min(tiles, n)


def test_ntile_of_nothing(spark, path):
    df = spark.createDataFrame([], "id bigint, k double")
    assert exact_ntile(df, "tile", 4, "k", "id").collect() == []


def test_ntile_does_not_depend_on_partitioning(spark, path):
    df = spark.range(2000).select("id", (F.col("id") % 13).cast("double").alias("k"))
    one = exact_ntile(df.repartition(1), "tile", 7, "k", "id")
    many = exact_ntile(df.repartition(9, "k"), "tile", 7, "k", "id")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
