"""Readable feature names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Display texts of the features.
FEATURE_LABELS = {
    "lag_1": "Price 15 Minutes Ago",
    "lag_4": "Price 1 Hour Ago",
    "lag_12": "Price 3 Hours Ago",
    "lag_24": "Price 6 Hours Ago",
    "lag_96": "Price 1 Day Ago",
    "lag_672": "Price 1 Week Ago",
    "is_weekend": "Weekend Indicator",
    "rolling_mean_4": "1-Hour Rolling Mean",
    "rolling_std_4": "1-Hour Rolling Volatility",
    "rolling_mean_12": "3-Hour Rolling Mean",
    "rolling_std_12": "3-Hour Rolling Volatility",
    "rolling_mean_24": "6-Hour Rolling Mean",
    "rolling_std_24": "6-Hour Rolling Volatility",
    "rolling_mean_48": "12-Hour Rolling Mean",
    "rolling_std_48": "12-Hour Rolling Volatility",
    "rolling_mean_96": "1-Day Rolling Mean",
    "rolling_std_96": "1-Day Rolling Volatility",
    "rolling_mean_192": "2-Day Rolling Mean",
    "rolling_std_192": "2-Day Rolling Volatility",
    "rolling_mean_672": "1-Week Rolling Mean",
    "rolling_std_672": "1-Week Rolling Volatility",
    "hour": "Hour of Day",
    "day_of_week": "Day of Week",
    "month": "Month",
    "hour_sin": "Hour of Day Cycle (Sine)",
    "hour_cos": "Hour of Day Cycle (Cosine)",
    "day_of_week_sin": "Weekday Cycle (Sine)",
    "day_of_week_cos": "Weekday Cycle (Cosine)",
    "month_sin": "Annual Seasonality (Sine)",
    "month_cos": "Annual Seasonality (Cosine)",
    "load_change_1": "15-Minute Load Change",
    "load_change_4": "1-Hour Load Change",
    "load_deviation_96": "Load Deviation from 24-Hour Average",
    "load_volatility_24": "6-Hour Load Volatility",
    "temp_lag_1": "Temperature 15 Minutes Ago",
    "temp_lag_4": "Temperature 1 Hour Ago",
    "temp_change_1": "15-Minute Temperature Change",
    "temp_change_4": "1-Hour Temperature Change",
    "temp_rolling_mean_24": "1-Day Temperature Rolling Mean",
    "temp_volatility_24": "1-Day Temperature Rolling Volatility",
    "wind_lag_1": "Wind 15 Minutes Ago",
    "wind_change_4": "1-Hour Wind Change",
    "wind_rolling_mean_24": "1-Hour Wind Rolling Mean",
    "wind_volatility_24": "1-Day Wind Rolling Volatility",
    "solar_lag_1": "Solar Radiation 15 Minutes Ago",
    "solar_change_4": "1-Hour Solar Radiation Change",
    "solar_rolling_mean_4": "1-Hour Solar Radiation Rolling Mean",
    "solar_volatility_24": "1-Day Solar Radiation Rolling Volatility",
    "cloud_lag_1": "Cloud Coverage 15 Minutes Ago",
    "cloud_change_4": "1-Hour Cloud Coverage Change",
    "dew_lag_1": "Dewpoint 15 Minutes Ago",
    "dew_change_4": "1-Hour Dewpoint Change",
    "precip_lag_1": "Precipitation 15 Minutes Ago",
    "heat_index_proxy_1": "Heat Index Proxy 15 Minutes Ago",
}


def feature_label(name: Column | str) -> Column:
    """Label of a feature, or the feature's own name."""
    key = F.col(name) if isinstance(name, str) else name
    labels = F.create_map(*[F.lit(x) for pair in FEATURE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, key), key)
