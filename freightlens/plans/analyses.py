"""The analyses: each takes the shipment fact and returns its report.

Thresholds are arguments; their defaults are the values the reports are defined with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions import (
    day,
    hour_of_day,
    round_half_up,
    weekday_from_zero,
    whole_hours,
)
from freightlens.functions import share as plain_share
from freightlens.operators import (
    Rows,
    bin_column,
    capacity_windows,
    cross_profile,
    exact_ntile,
    excursion_association,
    feature_set,
    group_profile,
    group_quantiles,
    iqr_outliers,
    label_rank,
    lag_features,
    lead_corr,
    mean,
    mean_of_period_means,
    next_event_after,
    pearson_ranked,
    pearson_wide,
    period_union,
    quality_profile,
    rolling_rows_mean,
    seasonal_forecast,
    share,
    share_where,
    sigma_excursions,
    top_ranked,
    transition_events,
    value_summary,
)

# Thresholds, cut points and labels of the reports.
HIGH_RISK = 7
PORT_CUTS, PORT_BINS = (0.33, 0.66), ("low", "medium", "high")
CUSTOMS_CUTS, CUSTOMS_BINS = (1, 3), ("fast", "normal", "slow")
RISK_CUTS, RISK_BUCKETS = (3, 6, 8), ("Low", "Moderate", "High", "Severe")
HOUR_CUTS, DAY_PARTS = (6, 12, 18), ("Night", "Morning", "Afternoon", "Evening")
QUARTERS = {"p25": "0.25", "p50": "0.50", "p75": "0.75"}


def _high_risk(threshold: float) -> Column:
    return F.col("route_risk_level") >= threshold


def fuel_by_risk(shipments: DataFrame) -> DataFrame:
    return group_profile(
        shipments,
        {"risk_classification": F.col("risk_classification")},
        {"avg_fuel_rate": mean("fuel_consumption_rate")},
        {"avg_fuel_rate": 4},
    ).orderBy(F.desc("avg_fuel_rate"))


def fuel_hour_by_traffic(shipments: DataFrame) -> DataFrame:
    return cross_profile(
        shipments,
        ("hour_of_day", hour_of_day("timestamp")),
        ("traffic_congestion_level", F.col("traffic_congestion_level")),
        "fuel_consumption_rate",
        ("fuel_by_hour", "fuel_by_traffic"),
    ).orderBy("hour_of_day", "traffic_congestion_level")


def fuel_correlations(shipments: DataFrame) -> DataFrame:
    fuel = "fuel_consumption_rate"
    return pearson_wide(
        shipments,
        {
            "corr_fuel_traffic": (fuel, "traffic_congestion_level"),
            "corr_fuel_weather": (fuel, "weather_condition_severity"),
        },
    )


def daily_peak_inventory(shipments: DataFrame) -> DataFrame:
    return group_profile(
        shipments,
        {"day": day("timestamp")},
        {
            "peak_inventory": F.max("warehouse_inventory_level"),
            "fulfillment_rate": F.avg("order_fulfillment_status"),
        },
        {"fulfillment_rate": 4},
    ).orderBy("day")


def equipment_versus_delay(shipments: DataFrame) -> DataFrame:
    return group_profile(
        shipments,
        {"equipment_available": F.col("handling_equipment_availability")},
        {
            "avg_delivery_delay_hrs": mean("delivery_time_deviation"),
            "avg_loading_time_hrs": mean("loading_unloading_time"),
            "record_count": Rows(),
        },
        {"avg_delivery_delay_hrs": 2, "avg_loading_time_hrs": 2},
    ).orderBy(F.desc("equipment_available"))


def eta_by_day_and_hour(shipments: DataFrame) -> DataFrame:
    return period_union(
        shipments,
        {"daily": day("timestamp"), "hourly": hour_of_day("timestamp")},
        "eta_variation_hours",
        "eta_var",
    ).orderBy("period_type", "period_value")


def deviation_quantiles(shipments: DataFrame) -> DataFrame:
    keyed = shipments.select(
        weekday_from_zero("timestamp").alias("dow"),
        hour_of_day("timestamp").alias("hr"),
        "delivery_time_deviation",
    )
    found = group_quantiles(keyed, "delivery_time_deviation", QUARTERS, "ceil", ["dow", "hr"])
    return found.select(
        "dow",
        "hr",
        round_half_up(F.col("p25"), 2).alias("deviation_25th"),
        round_half_up(F.col("p50"), 2).alias("deviation_median"),
        round_half_up(F.col("p75"), 2).alias("deviation_75th"),
    ).orderBy("dow", "hr")


def loading_outliers(shipments: DataFrame, factor: float = 1.5, top: int = 50) -> DataFrame:
    return (
        iqr_outliers(shipments, "loading_unloading_time", factor)
        .orderBy(F.desc("loading_unloading_time"), "shipment_id")
        .limit(top)
        .select("timestamp", "loading_unloading_time", "delivery_time_deviation", "bound")
    )


def delay_by_port_and_customs(shipments: DataFrame) -> DataFrame:
    return group_profile(
        shipments,
        {
            "port_bin": bin_column(F.col("port_congestion_level"), PORT_CUTS, PORT_BINS),
            "customs_bin": bin_column(
                F.col("customs_clearance_time"), CUSTOMS_CUTS, CUSTOMS_BINS
            ),
        },
        {
            "avg_deviation_hrs": mean("delivery_time_deviation"),
            "avg_delay_prob": mean("delay_probability"),
        },
        {"avg_deviation_hrs": 2, "avg_delay_prob": 4},
    ).orderBy(
        label_rank(F.col("port_bin"), PORT_BINS), label_rank(F.col("customs_bin"), CUSTOMS_BINS)
    )


def supplier_deciles(shipments: DataFrame, tiles: int = 10, top: int = 10) -> DataFrame:
    tiled = exact_ntile(
        shipments, "supplier_decile", tiles, "supplier_reliability_score", "shipment_id"
    )
    return (
        group_profile(
            tiled,
            {"supplier_decile": F.col("supplier_decile")},
            {
                "avg_lead_time_days": mean("lead_time_days"),
                "avg_reliability_score": mean("supplier_reliability_score"),
                "shipment_count": Rows(),
            },
            {"avg_lead_time_days": 2, "avg_reliability_score": 4},
        )
        .orderBy(F.desc("avg_lead_time_days"), "supplier_decile")
        .limit(top)
    )


def high_risk_percentage(shipments: DataFrame, threshold: float = HIGH_RISK) -> DataFrame:
    return share_where(shipments, _high_risk(threshold), "pct_high_risk_routes")


def conditions_by_risk(shipments: DataFrame, threshold: float = HIGH_RISK) -> DataFrame:
    return group_profile(
        shipments,
        {"risk_group": F.when(_high_risk(threshold), "High").otherwise("Low")},
        {
            "avg_traffic_congestion": mean("traffic_congestion_level"),
            "avg_weather_severity": mean("weather_condition_severity"),
            "record_count": Rows(),
        },
        {"avg_traffic_congestion": 2, "avg_weather_severity": 2},
    )


def temperature_summary(shipments: DataFrame) -> DataFrame:
    return value_summary(shipments, "iot_temperature", "temp")


def temperature_excursions(shipments: DataFrame, k: float = 3) -> DataFrame:
    return sigma_excursions(shipments, "iot_temperature", k).select(
        "timestamp", "iot_temperature"
    )


def excursions_versus_cargo(
    shipments: DataFrame, k: float = 2, threshold: float = HIGH_RISK
) -> DataFrame:
    return excursion_association(
        shipments,
        "iot_temperature",
        "cargo_condition_status",
        {"high_route_risk": _high_risk(threshold)},
        "temp_excursion",
        "avg_cargo_condition",
        k=k,
    )


def lagged_features(shipments: DataFrame, late_hours: float = 1) -> DataFrame:
    daily = shipments.groupBy(day("timestamp").alias("dt"), "route_risk_level").agg(
        F.avg("traffic_congestion_level").alias("avg_traffic"),
        F.avg("weather_condition_severity").alias("avg_weather"),
        F.avg("delivery_time_deviation").alias("avg_delay"),
        plain_share(F.col("delivery_time_deviation") > late_hours).alias("delay_flag"),
    )
    lags = {
        "traffic_lag1": "avg_traffic",
        "weather_lag1": "avg_weather",
        "delay_lag1": "avg_delay",
    }
    columns = [c for lag, source in lags.items() for c in (source, lag)] + ["delay_flag"]
    featured = lag_features(daily, "route_risk_level", "dt", lags)
    return featured.select("dt", "route_risk_level", *columns)


def predictor_ranking(shipments: DataFrame) -> DataFrame:
    features = [
        "traffic_congestion_level",
        "weather_condition_severity",
        "eta_variation_hours",
        "route_risk_level",
    ]
    return pearson_ranked(shipments, features, "delivery_time_deviation")


def top_routes(shipments: DataFrame, k: int = 5) -> DataFrame:
    routes = shipments.groupBy(F.col("route_risk_level").alias("recommended_route")).agg(
        F.avg("fuel_consumption_rate").alias("avg_fuel"),
        F.avg("delivery_time_deviation").alias("avg_delay"),
    )
    best = top_ranked(routes, ["avg_delay", "avg_fuel"], k, "route_rank")
    return best.drop("route_rank")


def unloading_windows(shipments: DataFrame, capacity: int = 10, tiles: int = 5) -> DataFrame:
    tiled = exact_ntile(
        shipments, "warehouse_bucket", tiles, "warehouse_inventory_level", "shipment_id"
    )
    return capacity_windows(
        tiled.withColumn("dt", day("timestamp")),
        ["dt", "warehouse_bucket"],
        "loading_unloading_time",
        "shipment_id",
        capacity,
        "unload_window",
        "shipments_in_window",
        "avg_load_time",
    )


def demand_forecast(
    shipments: DataFrame, last_week: int = 7, last_year: int = 365, rows: int = 30
) -> DataFrame:
    return seasonal_forecast(
        shipments, day("timestamp"), "historical_demand", last_week, last_year, rows
    )


def driver_quartiles(
    shipments: DataFrame,
    low_behavior: float = 0.5,
    low_fatigue: float = 0.5,
    high_delay: float = 0.7,
    tiles: int = 4,
) -> DataFrame:
    incident = (
        (F.col("driver_behavior_score") < low_behavior)
        | (F.col("fatigue_monitoring_score") < low_fatigue)
        | (F.col("delay_probability") > high_delay)
    )
    tiled = exact_ntile(shipments, "driver_bin", tiles, "driver_behavior_score", "shipment_id")
    return group_profile(
        tiled,
        {"driver_bin": F.col("driver_bin")},
        {
            "avg_fuel_rate": mean("fuel_consumption_rate"),
            "avg_eta_variation": mean("eta_variation_hours"),
            "incident_rate": share(incident),
        },
        {"avg_fuel_rate": 3, "avg_eta_variation": 3, "incident_rate": 3},
    ).orderBy("driver_bin")


def equipment_downtime(shipments: DataFrame, months: int = 6) -> DataFrame:
    changes = transition_events(
        shipments, "timestamp", "shipment_id", "handling_equipment_availability"
    )
    went_down = (F.col("state") == 0) & (F.col("prev_state") == 1)
    came_back = (F.col("state") == 1) & (F.col("prev_state") == 0)
    spans = next_event_after(changes, went_down, came_back)
    hours = whole_hours(F.col("start_time"), F.col("end_time"))
    monthly = group_profile(
        spans,
        {"yr": F.year("start_time"), "mth": F.month("start_time")},
        {"avg_downtime_hours": F.avg(hours), "event_count": F.count(F.lit(1))},
        {"avg_downtime_hours": 1},
    )
    return rolling_rows_mean(
        monthly, ["yr", "mth"], "avg_downtime_hours", "rolling_6mo_avg_downtime", months, 1
    ).orderBy("yr", "mth")


def warehouse_quartiles(shipments: DataFrame, tiles: int = 4) -> DataFrame:
    tiled = exact_ntile(
        shipments, "warehouse_quartile", tiles, "warehouse_inventory_level", "shipment_id"
    )
    return mean_of_period_means(
        tiled,
        day("timestamp"),
        "warehouse_quartile",
        {
            "overall_avg_inventory": ("warehouse_inventory_level", 2),
            "overall_fulfillment_rate": ("order_fulfillment_status", 4),
        },
    ).orderBy(F.desc("overall_fulfillment_rate"))


def supplier_lead_times(shipments: DataFrame, tiles: int = 10, top: int = 5) -> DataFrame:
    tiled = exact_ntile(
        shipments, "supplier_decile", tiles, "supplier_reliability_score", "shipment_id"
    )
    return (
        mean_of_period_means(
            tiled,
            day("timestamp"),
            "supplier_decile",
            {
                "overall_avg_lead_time": ("lead_time_days", 2),
                "overall_avg_reliability": ("supplier_reliability_score", 4),
            },
        )
        .orderBy(F.desc("overall_avg_lead_time"), "supplier_decile")
        .limit(top)
    )


def lagged_equipment_correlation(shipments: DataFrame) -> DataFrame:
    without = F.when(F.col("handling_equipment_availability") == 0, 1).otherwise(0)
    return lead_corr(shipments, day("timestamp"), without, F.col("delivery_time_deviation"))


def data_quality(shipments: DataFrame) -> DataFrame:
    return quality_profile(
        shipments,
        {
            "warehouse_inventory_level": ("pct_null_inventory", "inv_variability"),
            "handling_equipment_availability": ("pct_null_equipment", "equip_variability"),
            "supplier_reliability_score": ("pct_null_supplier_rel", "sup_rel_variability"),
        },
    )


def risk_by_time_of_day(shipments: DataFrame) -> DataFrame:
    return group_profile(
        shipments,
        {
            "risk_bucket": bin_column(F.col("route_risk_level"), RISK_CUTS, RISK_BUCKETS),
            "time_of_day": bin_column(hour_of_day("timestamp"), HOUR_CUTS, DAY_PARTS),
        },
        {
            "avg_delay_prob": mean("delay_probability"),
            "avg_disruption_prob": mean("disruption_likelihood_score"),
        },
        {"avg_delay_prob": 4, "avg_disruption_prob": 4},
    ).orderBy("risk_bucket", "time_of_day")


def model_features(shipments: DataFrame) -> DataFrame:
    return feature_set(
        shipments,
        [
            "timestamp",
            "traffic_congestion_level",
            "weather_condition_severity",
            "route_risk_level",
            "eta_variation_hours",
            "fatigue_monitoring_score",
            "hour",
            "dayofweek",
            "warehouse_inventory_level",
            "loading_unloading_time",
            "handling_equipment_availability",
            "supplier_reliability_score",
            "lead_time_days",
            "iot_temperature",
            "driver_behavior_score",
            "label_disruption",
            "label_delay",
        ],
        {
            "hour": hour_of_day("timestamp"),
            "dayofweek": F.dayofweek("timestamp"),
            "label_disruption": F.col("disruption_likelihood_score"),
            "label_delay": F.col("delivery_time_deviation"),
        },
    )
