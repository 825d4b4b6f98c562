"""The plans stay fit for large inputs: pruned scans, no cross joins, no single-task sorts."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from freightlens.operators import (
    capacity_windows,
    exact_ntile,
    group_quantiles,
    order_stats,
    top_ranked,
)
from freightlens.plans import ANALYSES, run
from freightlens.plans.catalog import COMPARED_COLUMNS, READ_AGAIN
from freightlens.sources import load_shipments, stored

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ANALYSES)
def test_no_cross_join(spark, name):
    text = plan(run(name, spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(run("q01_fuel_by_risk", spark, SF))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert schemas == {
        "event_id:bigint",
        "o_orderkey:bigint,o_orderpriority:string",
        "l_orderkey:bigint,l_quantity:double",
    }


def test_unused_line_items_are_not_read(spark):
    text = plan(run("q11_pct_high_risk", spark, SF))
    assert "l_orderkey" not in text


def test_hour_and_level_means_share_one_scan(spark):
    df = run("q02_fuel_hour_x_traffic", spark, SF)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_predictors_come_from_one_aggregate(spark):
    text = plan(run("q16b_predictor_ranking", spark, SF))
    assert text.count("events.parquet") == 1


def test_rank_is_limited_per_partition_first(spark):
    df = spark.range(100).select((F.col("id") % 50).alias("v"))
    assert "WindowGroupLimit" in plan(top_ranked(df, ["v"], 5, "r"))


def test_outliers_use_top_k(spark):
    assert "TakeOrderedAndProject" in plan(run("q08_loading_outliers", spark, SF))


def test_tiles_are_assigned_without_moving_the_table(spark):
    rows = stored(load_shipments(spark, SF).select("shipment_id", "warehouse_inventory_level"), "t")
    text = plan(exact_ntile(rows, "tile", 5, "warehouse_inventory_level", "shipment_id"))
    assert "Exchange" not in text and "Window" not in text


def test_brackets_are_compiled_comparisons(spark, monkeypatch):
    """A pass of the rank search has no window, no sort of rows and no interpreted lambda."""
    seen = []
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7).alias("id"))
    whole = type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda df: seen.append(plan(df)) or whole(df))
    exact_ntile(rows, "tile", 4, "k", "id")
    assert seen
    for text in seen:
        assert "Window" not in text and "rangepartitioning" not in text and "lambda" not in text
        below = text[text.index("HashAggregate") :]
        assert "Sort" not in below and below.count("Exchange") == 1


def test_cells_of_groups_are_summed_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    text = plan(group_quantiles(rows, "v", {"a": "0.5"}, "ceil", ["g"]))
    assert "partial_count" in text and "lambda" not in text and "rangepartitioning" not in text


def test_windows_meet_detail_by_range_and_group(spark):
    """A group that holds most rows is joined range by range."""
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(-1).alias("g"), F.rand(1).alias("v")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(capacity_windows(rows, ["g"], "v", "id", 10, "w", "n", "m"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", text)
    assert joins and all("part" in keys for keys in joins)


def test_state_changes_shuffle_the_detail_once(spark):
    """Also where one moment holds most rows, which is cut by the tie-break."""
    moment = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    later = F.timestamp_add("MINUTE", F.col("id").cast("int"), moment)
    rows = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, later).otherwise(moment).alias("t"), "id", (F.col("id") % 2).alias("s")
    )
    series = rows.select(F.col("t").alias("at"), F.col("id").alias("tie"))
    cuts = order_stats.range_cuts(series, "at", "tie", 16)
    numbered = order_stats.with_range_number(series, "part", "at", "tie", cuts)
    sizes = [r["count"] for r in numbered.groupBy("part").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 4000 / 16 * 2
    compared = numbered.withColumn(
        "before", F.lag("tie").over(Window.partitionBy("part").orderBy("at", "tie"))
    )
    text = plan(compared.groupBy("part", "at").agg(F.max("before")))
    assert text.count("Exchange") == 1 and "rangepartitioning" not in text


def test_unused_customers_are_not_read(spark):
    assert "c_custkey" not in plan(run("q11_pct_high_risk", spark, SF))


def test_analyses_report_unrounded_values(spark):
    """Only the registered query rounds what the report gives as computed."""
    facts = load_shipments(spark, "/root/testdata/sf0.01")
    for name, columns in COMPARED_COLUMNS.items():
        whole = ANALYSES[name](facts).select(*columns).collect()
        values = [v for row in whole for v in row if v is not None]
        assert name == "q23_data_quality" or any(v != round(v, 6) for v in values)
        assert run(name, spark, "/root/testdata/sf0.01").columns == ANALYSES[name](facts).columns


def test_stored_columns_are_those_the_analysis_reads(spark):
    """An analysis run on the narrow stored table sees every column it asks for."""
    facts = load_shipments(spark, SF)
    for name, columns in READ_AGAIN.items():
        assert set(columns) <= set(facts.columns)
        ANALYSES[name](facts.select(*columns)).schema


def test_range_lookup_grows_with_the_logarithm(spark):
    """2,000 cuts are eleven steps, each compiled; numbers equal counting the cuts before."""
    rows = spark.range(3000).select((F.col("id") * 37 % 1000).cast("double").alias("k"), F.col("id").alias("t"))
    rows = rows.union(spark.createDataFrame([(None, 1), (float("nan"), 2), (float("inf"), 3)], rows.schema))
    cuts = sorted({(float(k), t) for k in range(0, 1000, 3) for t in (5.0, 1500.0)} | {(float(k), None) for k in range(0, 1000, 2)},
                  key=lambda c: (c[0], c[1] is None, c[1] or 0.0))
    found = order_stats.with_range_number(rows, "n", "k", "t", cuts)
    text = plan(found)
    assert text.count("Project") <= 3 + len(cuts).bit_length() and "lambda" not in text
    for r in found.collect():
        after = [c for c in cuts if r.k is not None and (r.k != r.k or (r.k, r.t) > (c[0], float("inf") if c[1] is None else c[1]))]
        assert r.n == len(after)
    assert {r.n for r in order_stats.with_range_number(rows, "n", "k", "t", []).collect()} == {0}
