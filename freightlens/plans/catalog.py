"""Names of the analyses and how to run them over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freightlens.functions import rounded
from freightlens.plans import analyses as a
from freightlens.sources import SHIPMENT_SCHEMA, load_shipments, stored

ANALYSES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "q01_fuel_by_risk": a.fuel_by_risk,
    "q02_fuel_hour_x_traffic": a.fuel_hour_by_traffic,
    "q03_corr_fuel": a.fuel_correlations,
    "q04_daily_peak_inventory": a.daily_peak_inventory,
    "q05_equipment_vs_delay": a.equipment_versus_delay,
    "q06_eta_daily_hourly": a.eta_by_day_and_hour,
    "q07_deviation_quantiles": a.deviation_quantiles,
    "q08_loading_outliers": a.loading_outliers,
    "q09_port_customs_bins": a.delay_by_port_and_customs,
    "q10_supplier_deciles": a.supplier_deciles,
    "q11_pct_high_risk": a.high_risk_percentage,
    "q12_risk_cooccurrence": a.conditions_by_risk,
    "q13_temperature_summary": a.temperature_summary,
    "q14_temperature_excursions": a.temperature_excursions,
    "q15_excursion_vs_cargo": a.excursions_versus_cargo,
    "q16a_lagged_features": a.lagged_features,
    "q16b_predictor_ranking": a.predictor_ranking,
    "q17a_top_routes": a.top_routes,
    "q17b_unload_windows": a.unloading_windows,
    "q18_demand_forecast": a.demand_forecast,
    "q19_driver_quartiles": a.driver_quartiles,
    "q20_equipment_downtime": a.equipment_downtime,
    "q21a_warehouse_quartiles": a.warehouse_quartiles,
    "q21b_supplier_lead_time": a.supplier_lead_times,
    "q22_lagged_equipment_corr": a.lagged_equipment_correlation,
    "q23_data_quality": a.data_quality,
    "q24_risk_by_time_of_day": a.risk_by_time_of_day,
    "q25_feature_set": a.model_features,
}

# Analyses that read the fact more than once, with the columns they read. Over
# star tables the fact is a join, so these columns are stored once first.
READ_AGAIN: dict[str, list[str]] = {
    "q07_deviation_quantiles": ["timestamp", "delivery_time_deviation"],
    "q08_loading_outliers": [
        "shipment_id", "timestamp", "loading_unloading_time", "delivery_time_deviation",
    ],
    "q10_supplier_deciles": ["shipment_id", "supplier_reliability_score", "lead_time_days"],
    "q13_temperature_summary": ["iot_temperature"],
    "q14_temperature_excursions": ["timestamp", "iot_temperature"],
    "q15_excursion_vs_cargo": ["iot_temperature", "route_risk_level", "cargo_condition_status"],
    "q17b_unload_windows": [
        "shipment_id", "timestamp", "warehouse_inventory_level", "loading_unloading_time",
    ],
    "q19_driver_quartiles": [
        "shipment_id", "driver_behavior_score", "fatigue_monitoring_score", "delay_probability",
        "fuel_consumption_rate", "eta_variation_hours",
    ],
    "q21a_warehouse_quartiles": [
        "shipment_id", "timestamp", "warehouse_inventory_level", "order_fulfillment_status",
    ],
    "q21b_supplier_lead_time": [
        "shipment_id", "timestamp", "supplier_reliability_score", "lead_time_days",
    ],
}

# Of the others, those that read the inventory level, for which customers are joined.
READ_INVENTORY = ("q04_daily_peak_inventory", "q23_data_quality", "q25_feature_set")

# Analyses report these columns as computed. Registered queries round them, so that the
# last bits of a differently ordered sum do not show when results are compared.
COMPARED_DIGITS = 6
COMPARED_COLUMNS: dict[str, list[str]] = {
    "q16a_lagged_features": [
        "avg_traffic", "traffic_lag1", "avg_weather", "weather_lag1", "avg_delay", "delay_lag1",
        "delay_flag",
    ],
    "q16b_predictor_ranking": ["corr_value"],
    "q17a_top_routes": ["avg_fuel", "avg_delay"],
    "q23_data_quality": ["pct_null_inventory", "pct_null_equipment", "pct_null_supplier_rel"],
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run one analysis over the star tables in ``sf_dir``.

    Analyses that read the fact several times store it, and those that locate ranks run
    jobs, when this is called. What was stored is removed by ``sources.clear_stored``, or, if
    this is called inside ``sources.owned_tables``, by that block's handle.
    """
    columns = READ_AGAIN.get(name) or [
        c
        for c in SHIPMENT_SCHEMA.fieldNames()
        if name in READ_INVENTORY or c != "warehouse_inventory_level"
    ]
    shipments = load_shipments(spark, sf_dir, columns)
    if name in READ_AGAIN:
        shipments = stored(shipments, name)
    return rounded(ANALYSES[name](shipments), COMPARED_DIGITS, *COMPARED_COLUMNS.get(name, []))
