"""Series that Spark derives from the given tables, and the same in SQL.

A hub is a hundred users, so the number of series grows with the data.  Event
values stand in for prices, load and weather; the logarithm keeps averages off
exact decimal halves, where rounding could differ between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatt.operators.blocks import block_window, drop_copies, with_blocks
from tidewatt.operators.metrics import residuals
from tidewatt.operators.positions import slot_position
from tidewatt.operators.resample import collapse_duplicates, fill_forward, floor_slot
from tidewatt.operators.rolling import Trailing, add_trailing, drop_states
from tidewatt.registry.base import table

SERIES = ["hub", "series_id"]

# Measures of the stand-in weather: one event type each, and the hour's low.
WEATHER_TYPES = {
    "temperature": "view",
    "dew_point": "click",
    "wind_speed": "error",
    "cloud_cover": "purchase",
    "shortwave_radiation": "signup",
}


def readings(spark: SparkSession, folder: str) -> DataFrame:
    hub = F.expr("user_id div 100")
    return table(spark, folder, "events").select(
        "event_id",
        hub.alias("hub"),
        F.concat_ws("-", hub.cast("string"), "event_type").alias("series_id"),
        "event_type",
        "ts",
        "value",
        (40 * F.log(1 + F.col("value")) - 60).alias("price"),
    )


def price_slots(spark: SparkSession, folder: str) -> DataFrame:
    rows = readings(spark, folder).withColumn("time_stamp", floor_slot("ts"))
    return collapse_duplicates(rows, SERIES, ["price"])


def price_grid(spark: SparkSession, folder: str) -> DataFrame:
    return fill_forward(price_slots(spark, folder), SERIES).withColumn("pos", slot_position("time_stamp"))


def load_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hour-ending load per hub."""
    hour_end = floor_slot("ts", 3600) + F.expr("INTERVAL '1' HOUR")
    return (
        readings(spark, folder)
        .groupBy("hub", hour_end.alias("time_stamp"))
        .agg((1000 * F.log(1 + F.avg("value"))).alias("load"), (100 * F.log(1 + F.max("value"))).alias("coast_load"))
    )


def load_grid(spark: SparkSession, folder: str) -> DataFrame:
    shifted = load_hourly(spark, folder).withColumn("time_stamp", F.col("time_stamp") - F.expr("INTERVAL '45' MINUTE"))
    return fill_forward(shifted, ["hub"])


def weather_hourly(spark: SparkSession, folder: str, gaps: bool = True) -> DataFrame:
    """Hourly weather; without ``gaps`` an hour lacking a type takes the hour's mean."""

    def measure(kind):
        own = F.avg(F.when(F.col("event_type") == kind, F.col("value")))
        return F.log(1 + (own if gaps else F.coalesce(own, F.avg("value"))))

    measures = [measure(kind).alias(name) for name, kind in WEATHER_TYPES.items()]
    return (
        readings(spark, folder)
        .groupBy("hub", floor_slot("ts", 3600).alias("time_stamp"))
        .agg(*measures, F.log(1 + F.min("value")).alias("precipitation"))
    )


def weather_grid(spark: SparkSession, folder: str, gaps: bool = True) -> DataFrame:
    return fill_forward(weather_hourly(spark, folder, gaps), ["hub"])


def market(spark: SparkSession, folder: str) -> DataFrame:
    """Price grid with load and weather."""
    price = price_grid(spark, folder)
    on = ["hub", "time_stamp"]
    return price.join(load_grid(spark, folder), on, "left").join(
        weather_grid(spark, folder, gaps=False), on, "left"
    )


FORECAST = Trailing("fc", "price", (4,), minimum=1)


def forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing mean of up to four prior prices as the forecast of each price."""
    rows = add_trailing(with_blocks(price_grid(spark, folder), before=5), block_window(SERIES), [FORECAST])
    rows = drop_copies(drop_states(rows.withColumn("predicted", FORECAST.mean(4)), [FORECAST]))
    return rows.filter("predicted IS NOT NULL").select(
        *SERIES, "time_stamp", "pos", F.col("price").alias("actual"), "predicted"
    )


def order_residuals(spark: SparkSession, folder: str) -> DataFrame:
    """Line prices against a price-list estimate, one series per supplier."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("series_id"),
        F.col("l_shipdate").alias("time_stamp"),
        "l_orderkey", "l_linenumber", "l_partkey",
        F.log("l_extendedprice").alias("actual"),
        F.log(F.col("l_quantity") * 1500 * (1 - F.col("l_discount"))).alias("predicted"),
    )
    return residuals(lines)


# --- the same in SQL ---------------------------------------------------------

READINGS_SQL = """
readings AS (
  SELECT event_id, user_id // 100 AS hub, (user_id // 100) || '-' || event_type AS series_id,
         event_type, ts, value, 40 * ln(1 + value) - 60 AS price
  FROM events)"""

SLOTS_SQL = READINGS_SQL + """,
slots AS (
  SELECT hub, series_id, time_bucket(INTERVAL '15 minutes', ts) AS time_stamp, avg(price) AS price
  FROM readings GROUP BY ALL)"""


def filled_sql(name: str, source: str, key: str, columns: str) -> str:
    """Complete 15-minute grid of ``source`` by as-of join."""
    return f""",
{name}_points AS (
  SELECT {key}, unnest(generate_series(min(time_stamp), max(time_stamp), INTERVAL '15 minutes')) AS time_stamp
  FROM {source} GROUP BY {key}),
{name} AS (
  SELECT p.{key}, p.time_stamp, {columns}
  FROM {name}_points p ASOF JOIN {source} s ON p.{key} = s.{key} AND p.time_stamp >= s.time_stamp)"""


GRID_SQL = SLOTS_SQL + filled_sql(
    "price_grid", "slots", "series_id",
    "s.hub, s.price, epoch(p.time_stamp)::BIGINT // 900 AS pos",
)

LOAD_HOURLY_SQL = """,
load_hourly AS (
  SELECT hub, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS time_stamp,
         1000 * ln(1 + avg(value)) AS load, 100 * ln(1 + max(value)) AS coast_load
  FROM readings GROUP BY 1, 2)"""

LOAD_GRID_SQL = LOAD_HOURLY_SQL + """,
load_shifted AS (
  SELECT hub, time_stamp - INTERVAL '45 minutes' AS time_stamp, load, coast_load FROM load_hourly)""" + filled_sql(
    "load_grid", "load_shifted", "hub", "s.load, s.coast_load"
)



def weather_grid_sql(gaps: bool) -> str:
    def measure(kind: str) -> str:
        own = f"avg(value) FILTER (event_type = '{kind}')"
        return own if gaps else f"coalesce({own}, avg(value))"

    measures = ", ".join(f"ln(1 + {measure(kind)}) AS {name}" for name, kind in WEATHER_TYPES.items())
    return f""",
weather_hourly AS (
  SELECT hub, time_bucket(INTERVAL '1 hour', ts) AS time_stamp, {measures}, ln(1 + min(value)) AS precipitation
  FROM readings GROUP BY 1, 2)""" + filled_sql(
        "weather_grid", "weather_hourly", "hub", ", ".join(f"s.{c}" for c in [*WEATHER_TYPES, "precipitation"])
    )


def market_sql(gaps: bool) -> str:
    return GRID_SQL + LOAD_GRID_SQL + weather_grid_sql(gaps) + """,
market AS (
  SELECT p.*, l.load, l.coast_load, """ + ", ".join(f"w.{c}" for c in [*WEATHER_TYPES, "precipitation"]) + """
  FROM price_grid p
  LEFT JOIN load_grid l ON p.hub = l.hub AND p.time_stamp = l.time_stamp
  LEFT JOIN weather_grid w ON p.hub = w.hub AND p.time_stamp = w.time_stamp)"""


FORECAST_SQL = GRID_SQL + """,
forecast AS (
  SELECT hub, series_id, time_stamp, pos, price AS actual, predicted
  FROM (SELECT *, avg(price) OVER (PARTITION BY series_id ORDER BY time_stamp
                                   ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS predicted FROM price_grid)
  WHERE predicted IS NOT NULL)"""

ORDER_RESIDUALS_SQL = """
order_residuals AS (
  SELECT *, actual - predicted AS error, abs(actual - predicted) AS absolute_error
  FROM (SELECT l_suppkey AS series_id, l_shipdate AS time_stamp, l_orderkey, l_linenumber, l_partkey,
               ln(l_extendedprice) AS actual, ln(l_quantity * 1500 * (1 - l_discount)) AS predicted
        FROM lineitem))"""
