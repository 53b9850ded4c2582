"""Queries on lags, trailing windows, running values and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatt.operators.blocks import running
from tidewatt.operators.metrics import drawdown
from tidewatt.operators.positions import number_rows, slot_position
from tidewatt.operators.resample import fill_forward
from tidewatt.operators.rolling import look_ahead
from tidewatt.plans import features as ft, reports
from tidewatt.plans.rules import market_context, threshold_signal, with_thresholds
from tidewatt.registry import fixtures as fx
from tidewatt.registry.base import ORACLES, query, r, rounded, table
from tidewatt.settings import LOAD_STEPS, LOAD_WINDOWS, PRICE_LAGS, PRICE_WINDOWS, WEATHER_STEPS, Battery, with_scenarios

W = "PARTITION BY series_id ORDER BY time_stamp"
ID = ["series_id", "time_stamp"]


def gated(fn: str, c: str, k: int, offset: int = 1) -> str:
    """A trailing statistic that is null until the window is full."""
    frame = f"OVER ({W} ROWS BETWEEN {k - 1 + offset} PRECEDING AND {offset} PRECEDING)"
    if offset == 0:
        frame = f"OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} = {k} THEN {fn}({c}) {frame} END"


def lag(c: str, k: int) -> str:
    return f"lag({c}, {k}) OVER ({W})"


PRICE_SQL = {
    **{f"lag_{k}": lag("price", k) for k in PRICE_LAGS},
    **{f"rolling_mean_{k}": gated("avg", "price", k) for k in PRICE_WINDOWS},
    **{f"rolling_std_{k}": gated("stddev_samp", "price", k) for k in PRICE_WINDOWS},
}
LOAD_SQL = {
    **{f"load_lag_{k}": lag("load", k) for k in LOAD_STEPS},
    "known_load": lag("load", 1),
    **{f"load_rolling_mean_{k}": gated("avg", "load", k) for k in LOAD_WINDOWS},
    **{f"load_change_{s}": f"{lag('load', 1)} - {lag('load', 1 + s)}" for s in LOAD_STEPS},
    **{f"load_pct_change_{s}": f"{lag('load', 1)} / {lag('load', 1 + s)} - 1" for s in LOAD_STEPS},
    "load_deviation_96": f"{lag('load', 1)} - {gated('avg', 'load', 96)}",
    "load_volatility_24": gated("stddev_samp", "load", 24),
}
_M = ft.WEATHER
WEATHER_SQL = {
    **{f"temp_lag_{k}": lag(_M["temp"], k) for k in WEATHER_STEPS},
    **{f"temp_change_{k}": f"{_M['temp']} - {lag(_M['temp'], k)}" for k in WEATHER_STEPS},
    **{f"{f}_lag_1": lag(_M[f], 1) for f in ("wind", "solar", "cloud", "dew", "precip")},
    **{f"{f}_change_4": f"{_M[f]} - {lag(_M[f], 4)}" for f in ("wind", "solar", "cloud", "dew")},
    "heat_index_proxy_1": f"{lag(_M['temp'], 1)} + 0.2::DOUBLE * {lag(_M['dew'], 1)}",
    "temp_rolling_mean_24": gated("avg", _M["temp"], 24, 0),
    "temp_volatility_24": gated("stddev_samp", _M["temp"], 24, 0),
    "wind_rolling_mean_24": gated("avg", _M["wind"], 24, 0),
    "wind_volatility_24": gated("stddev_samp", _M["wind"], 24, 0),
    "solar_rolling_mean_4": gated("avg", _M["solar"], 4, 0),
    "solar_volatility_24": gated("stddev_samp", _M["solar"], 24, 0),
}
_CALENDAR_SQL = {
    "hour": "hour(time_stamp)::INT",
    "day_of_week": "((dayofweek(time_stamp) + 6) % 7)::INT",
    "month": "month(time_stamp)::INT",
    "is_weekend": "CASE WHEN (dayofweek(time_stamp) + 6) % 7 >= 5 THEN 1 ELSE 0 END::INT",
}
for _name, _value, _period in (
    ("hour", "hour(time_stamp)", 24),
    ("day_of_week", "((dayofweek(time_stamp) + 6) % 7)", 7),
    ("month", "(month(time_stamp) - 1)", 12),
):
    _CALENDAR_SQL[f"{_name}_sin"] = f"sin({_value} * 2 * pi() / {_period})"
    _CALENDAR_SQL[f"{_name}_cos"] = f"cos({_value} * 2 * pi() / {_period})"


def columns_sql(named: dict[str, str]) -> str:
    whole = {"hour", "day_of_week", "month", "is_weekend"}
    return ", ".join(f"{e} AS {n}" if n in whole else r(e, n) for n, e in named.items())


@query(
    "price_features",
    f"WITH {fx.GRID_SQL} SELECT series_id, time_stamp, {columns_sql(PRICE_SQL)} FROM price_grid",
)
def price_features(spark, folder):
    rows = ft.price_features(fx.price_grid(spark, folder), fx.SERIES)
    return rounded(rows.select(*ID, *PRICE_SQL))


@query(
    "load_features",
    f"WITH {fx.market_sql(gaps=False)} SELECT series_id, time_stamp, {columns_sql(LOAD_SQL)} FROM market",
)
def load_features(spark, folder):
    rows = fx.price_grid(spark, folder).join(fx.load_grid(spark, folder), ["hub", "time_stamp"], "left")
    return rounded(ft.load_features(rows, fx.SERIES).select(*ID, *LOAD_SQL))


@query(
    "weather_features",
    f"WITH {fx.market_sql(gaps=True)} SELECT series_id, time_stamp, {columns_sql(WEATHER_SQL)} FROM market",
)
def weather_features(spark, folder):
    rows = fx.price_grid(spark, folder).join(fx.weather_grid(spark, folder), ["hub", "time_stamp"], "left")
    return rounded(ft.weather_features(rows, fx.SERIES).select(*ID, *WEATHER_SQL))


ALL_SQL = {
    **{c: c for c in ("price", "load", "coast_load", *fx.WEATHER_TYPES, "precipitation")},
    **PRICE_SQL, **LOAD_SQL, **WEATHER_SQL, **_CALENDAR_SQL,
}


@query(
    "feature_table",
    f"""WITH {fx.market_sql(gaps=False)},
    f AS (SELECT series_id, time_stamp, {columns_sql(ALL_SQL)} FROM market)
    SELECT * FROM f WHERE {" AND ".join(f"{c} IS NOT NULL" for c in ALL_SQL)}""",
)
def feature_table(spark, folder):
    """Joined series, all features, complete rows only."""
    rows = ft.all_features(fx.market(spark, folder), fx.SERIES)
    return rounded(ft.complete_rows(rows.select(*ID, *ALL_SQL)))


CONTEXT_SQL = f""",
context AS (
  SELECT *, coalesce(avg(predicted) OVER w, first_value(predicted) OVER (PARTITION BY series_id ORDER BY time_stamp)) AS forecast_rolling_mean,
         coalesce(stddev_samp(predicted) OVER w, 0) AS forecast_rolling_volatility
  FROM forecast WINDOW w AS (PARTITION BY series_id ORDER BY time_stamp ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING))"""


@query(
    "market_context",
    f"""WITH {fx.FORECAST_SQL}{CONTEXT_SQL}
    SELECT series_id, time_stamp, {r('forecast_rolling_mean')}, {r('forecast_rolling_volatility')} FROM context""",
)
def context(spark, folder):
    rows = market_context(fx.forecast(spark, folder), fx.SERIES)
    return rounded(rows.select(*ID, "forecast_rolling_mean", "forecast_rolling_volatility"))


@query(
    "environment_scaling",
    f"""WITH {fx.FORECAST_SQL}{CONTEXT_SQL},
    stats AS (SELECT series_id, avg(predicted) AS m, stddev_samp(predicted) AS s,
                     quantile_cont(forecast_rolling_volatility, 0.95) AS v FROM context GROUP BY 1)
    SELECT c.series_id, c.time_stamp,
           {r('least(10, greatest(-10, (predicted - m) / CASE WHEN s >= 1e-8 THEN s ELSE 1 END))', 'forecast_scaled')},
           {r('least(10, greatest(-10, (forecast_rolling_mean - m) / CASE WHEN s >= 1e-8 THEN s ELSE 1 END))', 'mean_scaled')},
           {r('least(10, greatest(-10, forecast_rolling_volatility / CASE WHEN v >= 1e-8 THEN v ELSE 1 END))', 'volatility_scaled')},
           {r('(50.0 - 10.0) / 90.0', 'level_scaled')}
    FROM context c JOIN stats USING (series_id)""",
)
def environment_scaling(spark, folder):
    rows = with_scenarios(market_context(fx.forecast(spark, folder), fx.SERIES), [Battery()])
    rows = rows.withColumn("soc_start_mwh", F.col("initial_soc_mwh"))
    scaled = reports.environment_scaling(rows, ["series_id"])
    return rounded(scaled.select(*ID, "forecast_scaled", "mean_scaled", "volatility_scaled", "level_scaled"))


THRESHOLD_SQL = f""",
thresholds AS MATERIALIZED (
  SELECT *, CASE WHEN history >= 96 THEN lo END AS lower_threshold, CASE WHEN history >= 96 THEN hi END AS upper_threshold
  FROM (SELECT *, count(predicted) OVER w AS history, quantile_cont(predicted, 0.25) OVER w AS lo,
               quantile_cont(predicted, 0.75) OVER w AS hi
        FROM forecast WINDOW w AS (PARTITION BY series_id ORDER BY time_stamp ROWS BETWEEN 672 PRECEDING AND 1 PRECEDING))),
signals AS MATERIALIZED (
  SELECT *, CASE WHEN lower_threshold IS NULL OR upper_threshold IS NULL THEN 'hold'
                 WHEN predicted <= lower_threshold THEN 'charge'
                 WHEN predicted >= upper_threshold THEN 'discharge' ELSE 'hold' END AS request
  FROM thresholds)"""


@query(
    "threshold_signals",
    f"""WITH {fx.FORECAST_SQL}{THRESHOLD_SQL}
    SELECT series_id, time_stamp, {r('lower_threshold')}, {r('upper_threshold')}, request FROM signals""",
)
def threshold_signals(spark, folder):
    rows = with_thresholds(fx.forecast(spark, folder), fx.SERIES).withColumn("request", threshold_signal())
    return rounded(rows.select(*ID, "lower_threshold", "upper_threshold", "request"))


@query(
    "look_ahead",
    f"""WITH {fx.GRID_SQL}
    SELECT series_id, time_stamp, count(*) OVER w AS n, {r('sum(price) OVER w', 'total')},
           {r('last_value(price) OVER w', 'furthest')}
    FROM price_grid WINDOW w AS ({W} ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)""",
)
def ahead(spark, folder):
    return _ahead(look_ahead(fx.price_grid(spark, folder), fx.SERIES, "price", 16))


def _ahead(rows):
    return rounded(
        rows.select(
            *ID,
            F.size("ahead").cast("bigint").alias("n"),
            F.aggregate("ahead", F.lit(0.0), lambda a, x: a + x).alias("total"),
            F.element_at("ahead", -1).alias("furthest"),
        )
    )


#: Blocks so short that every series of the tables crosses many of their edges.
EDGE = 700


@query("price_features_across_blocks", ORACLES["price_features"])
def price_features_across_blocks(spark, folder):
    rows = ft.price_features(fx.price_grid(spark, folder), fx.SERIES, size=EDGE)
    return rounded(rows.select(*ID, *PRICE_SQL))


@query("threshold_signals_across_blocks", ORACLES["threshold_signals"])
def threshold_signals_across_blocks(spark, folder):
    rows = with_thresholds(fx.forecast(spark, folder), fx.SERIES, size=EDGE).withColumn("request", threshold_signal())
    return rounded(rows.select(*ID, "lower_threshold", "upper_threshold", "request"))


@query("look_ahead_across_blocks", ORACLES["look_ahead"])
def look_ahead_across_blocks(spark, folder):
    return _ahead(look_ahead(fx.price_grid(spark, folder), fx.SERIES, "price", 16, size=EDGE))


@query("price_on_grid_across_blocks", f"WITH {fx.GRID_SQL} SELECT hub, series_id, time_stamp, pos, {r('price')} FROM price_grid")
def price_on_grid_across_blocks(spark, folder):
    grid = fill_forward(fx.price_slots(spark, folder), fx.SERIES, size=EDGE)
    return rounded(grid.withColumn("pos", slot_position("time_stamp")).select("hub", *ID, "pos", "price"))


@query(
    "running_drawdown",
    f"""WITH e AS (
      SELECT *, sum(error) OVER (ORDER BY time_stamp, l_orderkey, l_linenumber, l_partkey, series_id
                                 ROWS UNBOUNDED PRECEDING) AS cumulative_profit,
             row_number() OVER (ORDER BY time_stamp, l_orderkey, l_linenumber, l_partkey, series_id) - 1 AS pos
      FROM (WITH {fx.ORDER_RESIDUALS_SQL} SELECT * FROM order_residuals)),
    p AS (SELECT *, max(cumulative_profit) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS running_peak FROM e)
    SELECT pos, {r('cumulative_profit', digits=3)}, {r('running_peak', digits=3)}, {r('cumulative_profit - running_peak', 'drawdown', 3)} FROM p""",
)
def running_drawdown(spark, folder):
    """One series that holds every row of the table, accumulated in blocks."""
    rows = fx.order_residuals(spark, folder).withColumn("_all", F.lit(1))
    order = ["time_stamp", "l_orderkey", "l_linenumber", "l_partkey", "series_id"]
    numbered = number_rows(rows.select("_all", *order, "error"), ["_all"], order).select("_all", "pos", "error")
    out = drawdown(numbered, ["_all"], "error", "pos")
    return rounded(out.select("pos", "cumulative_profit", "running_peak", "drawdown"), digits=3)


@query(
    "running_revenue_by_supplier",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           {r('sum(ln(l_extendedprice)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)', 'running', 4)}
    FROM lineitem""",
)
def running_revenue_by_supplier(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", F.log("l_extendedprice").alias("v")
    )
    numbered = number_rows(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])
    out = running(numbered, ["l_suppkey"], {"running": ("sum", "v")})
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "running"), digits=4)
