"""The shipment fact: one row per shipment observation.

Every operator takes the fact as a plain DataFrame. It may come from a flat
Parquet table (``read_fact``) or be derived from star-schema tables
(``load_shipments``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightlens.sources.hot_keys import hot_keys, is_broadcast, spread_join

_DOUBLE = T.DoubleType()
_INT = T.IntegerType()

SHIPMENT_SCHEMA = T.StructType(
    [
        T.StructField("shipment_id", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("risk_classification", T.StringType()),
        T.StructField("fuel_consumption_rate", _DOUBLE),
        T.StructField("traffic_congestion_level", _DOUBLE),
        T.StructField("weather_condition_severity", _DOUBLE),
        T.StructField("warehouse_inventory_level", _DOUBLE),
        T.StructField("order_fulfillment_status", _INT),
        T.StructField("handling_equipment_availability", _INT),
        T.StructField("delivery_time_deviation", _DOUBLE),
        T.StructField("loading_unloading_time", _DOUBLE),
        T.StructField("eta_variation_hours", _DOUBLE),
        T.StructField("port_congestion_level", _DOUBLE),
        T.StructField("customs_clearance_time", _DOUBLE),
        T.StructField("delay_probability", _DOUBLE),
        T.StructField("supplier_reliability_score", _DOUBLE),
        T.StructField("lead_time_days", _DOUBLE),
        T.StructField("route_risk_level", _DOUBLE),
        T.StructField("iot_temperature", _DOUBLE),
        T.StructField("cargo_condition_status", _INT),
        T.StructField("historical_demand", _DOUBLE),
        T.StructField("driver_behavior_score", _DOUBLE),
        T.StructField("fatigue_monitoring_score", _DOUBLE),
        T.StructField("disruption_likelihood_score", _DOUBLE),
    ]
)

# The star tables, as far as the fact needs them.
_STAR_TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_acctbal double",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_quantity double, l_discount double,"
    " l_tax double",
}

# How each shipment column is derived from the joined star tables.
_FROM_STAR = {
    "shipment_id": "event_id",
    "timestamp": "o_orderdate + make_dt_interval(0, hour(ts), minute(ts), 0)",
    "risk_classification": """
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High Risk'
             WHEN o_orderpriority = '5-LOW' THEN 'Low Risk'
             ELSE 'Moderate Risk' END""",
    "fuel_consumption_rate": "max_qty",
    "traffic_congestion_level": "round(max_tax * 100)",
    "weather_condition_severity": "min_disc * 10",
    "warehouse_inventory_level": "c_acctbal + 1000",
    "order_fulfillment_status": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "handling_equipment_availability": "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END",
    "delivery_time_deviation": "CAST(mod(o_orderkey * 7919, 1013) AS DOUBLE) / 100 - 2",
    "loading_unloading_time": "value",
    "eta_variation_hours": "mod(user_id * 13 + o_custkey, 17) - 5",
    "port_congestion_level": "CAST(mod(o_custkey, 100) AS DOUBLE) / 100",
    "customs_clearance_time": "CAST(mod(o_orderkey, 50) AS DOUBLE) / 10",
    "delay_probability": "CAST(mod(o_custkey * 7 + o_orderkey, 101) AS DOUBLE) / 100",
    "supplier_reliability_score": "CAST(mod(supp * 37, 101) AS DOUBLE) / 100",
    "lead_time_days": "1 + mod(o_orderkey * 3, 14)",
    "route_risk_level": "mod(user_id, 11)",
    "iot_temperature": """
        4 + CAST(mod(event_id * 31, 100) AS DOUBLE) / 10
          + CASE WHEN mod(event_id, 97) = 0 THEN 40 ELSE 0 END""",
    "cargo_condition_status": "CASE WHEN mod(o_orderkey, 5) = 0 THEN 0 ELSE 1 END",
    "historical_demand": "floor(o_totalprice)",
    "driver_behavior_score": "CAST(mod(user_id * 37, 101) AS DOUBLE) / 100",
    "fatigue_monitoring_score": "CAST(mod(user_id * 53 + event_id, 101) AS DOUBLE) / 100",
    "disruption_likelihood_score": "CAST(mod(event_id * 17, 101) AS DOUBLE) / 100",
}


def load_shipments(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Derive the fact, or the named columns of it, from the star tables in ``sf_dir``.

    The order-key joins come first and share one partitioning; line items are
    aggregated before they are joined, so a hot order is one row by then. The
    customer join is last. If the customers are too many to be broadcast and their column is
    wanted, customers who own a large part of all orders are looked for when this is called,
    and their orders are spread over several tasks. Line items and customers are one row
    per key and join from the left, so either side disappears when none of its columns is
    used; only the columns a caller selects are read.
    """
    wanted = list(columns or SHIPMENT_SCHEMA.fieldNames())

    def table(name: str) -> DataFrame:
        return spark.read.schema(_STAR_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")

    lines = table("lineitem").groupBy("l_orderkey").agg(
        F.max("l_quantity").alias("max_qty"),
        F.max("l_tax").alias("max_tax"),
        F.min("l_discount").alias("min_disc"),
        F.min("l_suppkey").alias("supp"),
    )
    customer = table("customer").groupBy("c_custkey").agg(F.max("c_acctbal").alias("c_acctbal"))
    events, orders = table("events"), table("orders")
    joined = events.join(orders, orders.o_orderkey == events.event_id).join(
        lines, orders.o_orderkey == lines.l_orderkey, "left"
    )
    spread = "warehouse_inventory_level" in wanted and not is_broadcast(customer)
    hot = hot_keys(orders, "o_custkey") if spread else []
    joined = spread_join(joined, customer, "o_custkey", "c_custkey", hot, ["event_id"])
    kinds = {f.name: f.dataType.simpleString() for f in SHIPMENT_SCHEMA}
    return joined.selectExpr(*(f"CAST({_FROM_STAR[c]} AS {kinds[c]}) AS {c}" for c in wanted))


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    """Read a flat fact table and check it against the declared schema."""
    fact = spark.read.parquet(path)
    found = {f.name: f.dataType for f in fact.schema}
    wrong = [f.name for f in SHIPMENT_SCHEMA if found.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"missing or differently typed shipment columns: {wrong}")
    return fact.select(*SHIPMENT_SCHEMA.fieldNames())


def register(shipments: DataFrame, name: str = "shipments") -> None:
    """Expose the fact to SQL users as a temporary view."""
    shipments.createOrReplaceTempView(name)
