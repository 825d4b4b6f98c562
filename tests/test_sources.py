from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from freightlens.plans import run
from freightlens.sources import (
    SHIPMENT_SCHEMA,
    clear_stored,
    hot_keys,
    load_shipments,
    owned_tables,
    read_fact,
    register,
    scratch_root,
    spread_join,
    stored,
)

SF = "/root/testdata/sf0.001"


def test_fact_has_the_declared_schema(spark):
    facts = load_shipments(spark, SF)
    assert [(f.name, f.dataType) for f in facts.schema] == [
        (f.name, f.dataType) for f in SHIPMENT_SCHEMA
    ]
    assert facts.count() == 1000
    assert facts.select("shipment_id").distinct().count() == 1000


def test_flat_fact_round_trip(spark, tmp_path):
    facts = load_shipments(spark, SF)
    facts.write.parquet(str(tmp_path / "fact"))
    again = read_fact(spark, str(tmp_path / "fact"))
    assert again.exceptAll(facts).isEmpty() and facts.exceptAll(again).isEmpty()


def test_flat_fact_is_checked(spark, tmp_path):
    facts = load_shipments(spark, SF).withColumn("iot_temperature", F.lit("warm"))
    facts.drop("delay_probability").write.parquet(str(tmp_path / "fact"))
    with pytest.raises(ValueError, match="delay_probability.*iot_temperature"):
        read_fact(spark, str(tmp_path / "fact"))


def test_register(spark):
    register(load_shipments(spark, SF))
    assert spark.sql("SELECT count(*) AS n FROM shipments").first()["n"] == 1000


def test_stored_tables_live_in_the_checkpoint_folder(spark):
    root = scratch_root(spark)
    assert root.startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = stored(spark.range(5), "numbers")
    assert all(root in file for file in kept.inputFiles())
    assert kept.count() == 5


def _session(conf):
    class Context:
        master = "spark://cluster:7077"
        applicationId = "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    Session.conf = conf
    return Session()


@pytest.mark.parametrize("key", ["spark.checkpoint.dir", "spark.sql.warehouse.dir"])
def test_a_cluster_folder_is_shared(key):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(_session({key: "file:/tmp/own"}))
    assert scratch_root(_session({key: "hdfs://n/shared"})).startswith("hdfs://n/shared/")


def test_nothing_is_left_after_the_process(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "{tmp_path}/shared").getOrCreate())
from freightlens.sources import stored
import os
stored(spark.range(3), "n").count()
assert os.listdir("{tmp_path}/shared/freightlens")
spark.stop()
"""
    root = str(Path(__file__).resolve().parent.parent)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root})
    assert os.listdir(tmp_path / "shared" / "freightlens") == []


def test_clear_stored(spark, monkeypatch, tmp_path):
    from freightlens.sources import scratch

    monkeypatch.setattr(scratch, "scratch_root", lambda _: str(tmp_path / "own"))
    stored(spark.range(5), "numbers")
    assert (tmp_path / "own").exists()
    clear_stored(spark)
    assert not (tmp_path / "own").exists()


def test_freeing_one_result_leaves_the_other(spark):
    """Two runs in one process, each with its own handle."""
    with owned_tables(spark) as first:
        one = run("q10_supplier_deciles", spark, SF)
    with owned_tables(spark) as second:
        two = run("q10_supplier_deciles", spark, SF)
    assert first.paths and second.paths and not set(first.paths) & set(second.paths)
    kept, paths = two.collect(), list(first.paths)
    first.free()
    first.free()
    assert not any(Path(p).exists() for p in paths)
    assert two.collect() == kept and all(Path(p).exists() for p in second.paths)
    with pytest.raises(Exception, match="does not exist|FileNotFound"):
        one.collect()
    second.free()


def test_files_of_a_session_only_file_system_are_freed(spark, tmp_path):
    """The scheme ``own`` is known to the session's settings only, not to Hadoop's defaults."""
    session = spark.newSession()
    session.conf.set("fs.own.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
    settings = session._jsparkSession.sessionState().newHadoopConf()
    assert settings.get("fs.own.impl") and not spark._jsparkSession.sessionState().newHadoopConf().get("fs.own.impl")
    folder = tmp_path / "tables"
    folder.mkdir()
    with owned_tables(session) as tables:
        tables.paths.append(f"own://{folder}")
    try:
        tables.free()
    except Exception as error:  # RawLocalFileSystem takes file: only, but it was found
        assert "own" in str(error) and "No FileSystem for scheme" not in str(error)


def task_sizes(df, joined):
    """Rows of each task that has any, in order; reads a joined column, so that the join stays."""
    found = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max(joined).alias("used"))
    return sorted(r.n for r in found.collect())


@pytest.fixture
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_keys_are_found(spark, no_broadcast):
    rows = spark.range(100_000).select(
        F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 5000).alias("k")
    )
    found = {r.key: r.pieces for r in hot_keys(rows, "k")}
    assert set(found) == {7, None} and 24 <= found[7] <= 48 and 4 <= found[None] <= 12
    assert hot_keys(spark.range(10_000).withColumnRenamed("id", "k"), "k") == []
    assert hot_keys(rows.limit(0), "k") == []


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_equals_a_plain_join(spark, no_broadcast, how):
    """Half the rows have one key, a tenth none, and some keys are missing on the other side."""
    detail = spark.range(40_000).select(
        "id", F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 500).alias("k")
    )
    other = spark.range(400).select(F.col("id").alias("o"), (F.col("id") % 3).alias("v")).groupBy("o").agg(F.max("v").alias("v"))
    hot = hot_keys(detail, "k")
    got = spread_join(detail, other, "k", "o", hot, ["id"], how)
    want = detail.join(other, F.col("k") == F.col("o"), how)
    assert hot and got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    if how == "left":
        sizes = task_sizes(got, "v")
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
        plain = task_sizes(want, "v")
        assert plain[-1] > 5 * plain[len(plain) // 2]


def test_hot_customers_are_spread(spark, no_broadcast, tmp_path):
    """A customer who owns half of all orders, in the fact as it is loaded."""
    big = "/root/testdata/sf0.01"
    for name in ("events", "lineitem", "customer"):
        os.symlink(f"{big}/{name}.parquet", tmp_path / f"{name}.parquet")
    orders = spark.read.parquet(f"{big}/orders.parquet")
    half = F.when(F.col("o_orderkey") % 2 == 0, F.lit(11).cast("long")).otherwise(F.col("o_custkey"))
    orders.withColumn("o_custkey", half).write.parquet(str(tmp_path / "orders.parquet"))
    facts = load_shipments(spark, str(tmp_path), ["shipment_id", "warehouse_inventory_level"])
    sizes = task_sizes(facts, "warehouse_inventory_level")
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert facts.where("shipment_id % 2 = 0").select("warehouse_inventory_level").distinct().count() == 1
