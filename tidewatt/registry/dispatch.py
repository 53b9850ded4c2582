"""Queries on schedules, their settlement and their reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidewatt.functions.scalars import time_text
from tidewatt.operators import metrics as mt
from tidewatt.operators.schedule import daily_schedule, perfect_foresight, rolling_schedule, settle_schedule
from tidewatt.operators.settle import realized_profit, terminal_value
from tidewatt.plans import reports
from tidewatt.plans.rules import action_log_backtest, market_context, rules_backtest
from tidewatt.plans.scaling import ContextScaler, ContextScalerModel
from tidewatt.registry import fixtures as fx
from tidewatt.registry.base import query, r, rounded
from tidewatt.registry.series import scratch
from tidewatt.registry.windows import CONTEXT_SQL, ID, THRESHOLD_SQL
from tidewatt.session import durable
from tidewatt.settings import Battery, with_scenarios
from tidewatt.sources import tables

KEYS = [*fx.SERIES, "scenario_id"]
SCENARIOS = [Battery(), Battery("small", capacity_mwh=40.0, max_charge_mw=8.0, max_discharge_mw=12.0, initial_soc_mwh=20.0)]
OUT = ["series_id", "scenario_id"]


def _log(spark, folder):
    """An action log: a fixed pattern of actions over the forecast rows."""
    m = F.pmod("pos", F.lit(7))
    code = F.when(m.isin(0, 1, 2), 0).when(m.isin(3, 6), 2).otherwise(1)
    return fx.forecast(spark, folder).withColumn("action_code", code)


def _replay_sql(source: str) -> str:
    """Levels step by step, then power, costs and revenue (all scenarios)."""
    scenarios = ", ".join(
        f"('{b.scenario_id}', {b.capacity_mwh}::DOUBLE, {b.initial_soc_mwh}::DOUBLE, {b.max_charge_mw}::DOUBLE, {b.max_discharge_mw}::DOUBLE)"
        for b in SCENARIOS
    )
    return f""",
scenarios AS (SELECT * FROM (VALUES {scenarios}) AS t(scenario_id, cap, s0, up, down)),
req AS MATERIALIZED (
  SELECT q.*, s.*, row_number() OVER (PARTITION BY series_id, scenario_id ORDER BY time_stamp) AS n
  FROM {source} q, scenarios s),
paths AS MATERIALIZED (
  SELECT series_id, scenario_id, any_value(s0) AS s0, any_value(cap) AS cap,
         list(CASE request WHEN 'charge' THEN up * 0.2375::DOUBLE
              WHEN 'discharge' THEN -down * 0.25::DOUBLE / 0.95::DOUBLE ELSE 0 END ORDER BY n) AS steps
  FROM req GROUP BY 1, 2),
walked AS (
  SELECT series_id, scenario_id, 1::BIGINT AS n, s0 AS soc_start_mwh,
         least(cap, greatest(10::DOUBLE, s0 + steps[1])) AS soc_mwh
  FROM paths
  UNION ALL
  SELECT p.series_id, p.scenario_id, w.n + 1, w.soc_mwh, least(p.cap, greatest(10::DOUBLE, w.soc_mwh + p.steps[w.n + 1]))
  FROM walked w JOIN paths p ON p.series_id = w.series_id AND p.scenario_id = w.scenario_id WHERE w.n < len(p.steps)),
power AS (
  SELECT q.*, w.soc_start_mwh, w.soc_mwh,
         CASE WHEN request = 'charge' THEN greatest(0, least(up, (cap - soc_start_mwh) / 0.2375::DOUBLE)) ELSE 0::DOUBLE END AS charge_mw,
         CASE WHEN request = 'discharge' THEN greatest(0, least(down, (soc_start_mwh - 10) * 0.95::DOUBLE / 0.25::DOUBLE)) ELSE 0::DOUBLE END AS discharge_mw
  FROM req q JOIN walked w ON q.series_id = w.series_id AND q.scenario_id = w.scenario_id AND q.n = w.n),
settled AS (
  SELECT *, (discharge_mw - charge_mw) * 0.25::DOUBLE * actual AS gross_realized_revenue,
         5.0::DOUBLE * (charge_mw + discharge_mw) * 0.25::DOUBLE AS degradation_cost,
         0.5::DOUBLE * (charge_mw + discharge_mw) * 0.25::DOUBLE AS transaction_cost,
         CASE WHEN charge_mw > 1e-9 THEN 'Charge' WHEN discharge_mw > 1e-9 THEN 'Discharge' ELSE 'Hold' END AS action
  FROM power),
dispatch AS MATERIALIZED (
  SELECT *, gross_realized_revenue - degradation_cost - transaction_cost AS realized_revenue,
         sum(gross_realized_revenue - degradation_cost - transaction_cost)
           OVER (PARTITION BY series_id, scenario_id ORDER BY time_stamp ROWS UNBOUNDED PRECEDING) AS cumulative_profit
  FROM settled)"""


RULES_SQL = "WITH RECURSIVE" + fx.FORECAST_SQL + THRESHOLD_SQL + _replay_sql("signals")
LOG_SQL = (
    "WITH RECURSIVE" + fx.FORECAST_SQL + CONTEXT_SQL
    + """,
logged AS (SELECT *, CASE WHEN pos % 7 IN (0, 1, 2) THEN 'charge' WHEN pos % 7 IN (3, 6) THEN 'discharge' ELSE 'hold' END AS request FROM context)"""
    + _replay_sql("logged")
)
DISPATCHED = [
    "soc_start_mwh", "soc_mwh", "charge_mw", "discharge_mw", "gross_realized_revenue", "degradation_cost",
    "transaction_cost", "realized_revenue", "cumulative_profit",
]


def _rules(spark, folder, *columns: str):
    """The rule strategy with the named columns besides levels and power; with all if none is named."""
    return rules_backtest(fx.forecast(spark, folder), fx.SERIES, SCENARIOS, columns=list(columns) or None)


def _logged(spark, folder, *columns: str):
    return action_log_backtest(_log(spark, folder), fx.SERIES, SCENARIOS, columns=list(columns) or None)


@query(
    "rules_backtest",
    f"""{RULES_SQL} SELECT series_id, scenario_id, time_stamp, action, {r('lower_threshold')}, {r('upper_threshold')},
        {", ".join(r(c) for c in DISPATCHED)} FROM dispatch""",
)
def rules(spark, folder):
    rows = _rules(spark, folder)
    return rounded(rows.select(*OUT, "time_stamp", "action", "lower_threshold", "upper_threshold", *DISPATCHED))


@query(
    "action_log_backtest",
    f"{LOG_SQL} SELECT series_id, scenario_id, time_stamp, action, {', '.join(r(c) for c in DISPATCHED)} FROM dispatch",
)
def action_log(spark, folder):
    rows = _logged(spark, folder)
    return rounded(rows.select(*OUT, "time_stamp", "action", *DISPATCHED))


_SCALED = {
    "forecast_scaled": "(predicted - m) / s",
    "mean_scaled": "(forecast_rolling_mean - m) / s",
    "volatility_scaled": "forecast_rolling_volatility / v",
    "level_scaled": "(soc_start_mwh - 10) / (cap - 10)",
}


@query(
    "context_scaled_by_earlier_days",
    f"""{LOG_SQL},
    fitted AS (
      SELECT series_id, m, CASE WHEN s >= 1e-8 THEN s ELSE 1 END AS s, CASE WHEN v >= 1e-8 THEN v ELSE 1 END AS v
      FROM (SELECT series_id, avg(predicted) AS m, stddev_samp(predicted) AS s, quantile_cont(forecast_rolling_volatility, 0.95) AS v
            FROM context WHERE time_stamp < TIMESTAMP '2024-01-20' GROUP BY 1))
    SELECT series_id, scenario_id, time_stamp, {", ".join(r(f"least(10, greatest(-10, {e}))", n) for n, e in _SCALED.items())}
    FROM dispatch JOIN fitted USING (series_id) WHERE time_stamp >= TIMESTAMP '2024-01-20'""",
)
def context_scaled_by_earlier_days(spark, folder):
    """Scales fitted on the first days, saved, loaded and applied to the later days' rows and levels."""
    context = durable(market_context(_log(spark, folder), fx.SERIES))
    border = F.lit("2024-01-20").cast("timestamp_ntz")
    path = scratch(spark, "scales")
    ContextScaler(["series_id"]).fit(context.filter(F.col("time_stamp") < border)).save(path)
    # Levels carry on from the first days, so the whole log is replayed.
    kept = ["time_stamp", "predicted", "forecast_rolling_mean", "forecast_rolling_volatility"]
    played = action_log_backtest(context, fx.SERIES, SCENARIOS, columns=kept)
    later = played.filter(F.col("time_stamp") >= border)
    return rounded(ContextScalerModel.load(spark, path).transform(later).select(*OUT, "time_stamp", *_SCALED))


@query(
    "terminal_value",
    f"""{LOG_SQL}
    SELECT series_id, scenario_id, max(time_stamp) AS time_stamp, {r('arg_max(soc_mwh, time_stamp)', 'soc_mwh')},
           {r('sum(realized_revenue)', 'realized_profit')},
           {r('arg_max((soc_mwh - s0) * forecast_rolling_mean, time_stamp)', 'terminal_soc_adjustment')},
           {r('(sum(realized_revenue) + arg_max((soc_mwh - s0) * forecast_rolling_mean, time_stamp)) / 1000', 'episode_reward')}
    FROM dispatch GROUP BY 1, 2""",
)
def terminal(spark, folder):
    log = market_context(_log(spark, folder), fx.SERIES)
    columns = ["time_stamp", "forecast_rolling_mean", "realized_revenue"]
    return rounded(terminal_value(action_log_backtest(log, fx.SERIES, SCENARIOS, columns=columns), OUT))


DAILY_SQL = """,
daily AS (
  SELECT series_id, scenario_id, time_stamp::DATE AS date, sum(realized_revenue) AS daily_profit,
         sum(charge_mw * 0.25) AS charged_mwh, sum(discharge_mw * 0.25) AS discharged_mwh,
         sum((charge_mw + discharge_mw) * 0.25) AS throughput_mwh, avg(soc_mwh) AS average_soc_mwh,
         min(soc_mwh) AS minimum_soc_mwh, max(soc_mwh) AS maximum_soc_mwh,
         count(*) FILTER (charge_mw > 1e-6) AS charge_intervals,
         sum(discharge_mw * 0.25) / any_value(cap) AS equivalent_full_cycles
  FROM dispatch GROUP BY 1, 2, 3)"""
DAILY = [
    "daily_profit", "charged_mwh", "discharged_mwh", "throughput_mwh", "average_soc_mwh", "minimum_soc_mwh",
    "maximum_soc_mwh", "equivalent_full_cycles",
]


@query(
    "daily_table",
    f"""{RULES_SQL}{DAILY_SQL},
    c AS (SELECT *, sum(daily_profit) OVER (PARTITION BY series_id, scenario_id ORDER BY date) AS cumulative_profit FROM daily),
    p AS (SELECT *, max(cumulative_profit) OVER (PARTITION BY series_id, scenario_id ORDER BY date) AS running_peak FROM c)
    SELECT series_id, scenario_id, date, charge_intervals, {", ".join(r(c) for c in DAILY)},
           {r('cumulative_profit')}, {r('running_peak')}, {r('cumulative_profit - running_peak', 'drawdown')} FROM p""",
)
def daily_table(spark, folder):
    rows = mt.daily_table(_rules(spark, folder, "time_stamp", "realized_revenue"), OUT)
    return rounded(rows)


SUMMARY_SQL = f"""{DAILY_SQL},
equity AS (SELECT *, max(cumulative_profit) OVER (PARTITION BY series_id, scenario_id ORDER BY time_stamp ROWS UNBOUNDED PRECEDING) AS peak FROM dispatch),
by_interval AS (
  SELECT series_id, scenario_id, strftime(min(time_stamp), '%Y-%m-%dT%H:%M:%S') AS backtest_start,
         strftime(max(time_stamp), '%Y-%m-%dT%H:%M:%S') AS backtest_end, count(*) AS intervals,
         sum(realized_revenue) AS total_profit_usd, abs(min(cumulative_profit - peak)) AS maximum_drawdown_usd,
         CASE WHEN sum(CASE WHEN realized_revenue < 0 THEN realized_revenue ELSE 0 END) < 0
              THEN sum(CASE WHEN realized_revenue > 0 THEN realized_revenue ELSE 0 END)
                   / -sum(CASE WHEN realized_revenue < 0 THEN realized_revenue ELSE 0 END)
              WHEN sum(CASE WHEN realized_revenue > 0 THEN realized_revenue ELSE 0 END) > 0 THEN 'inf'::DOUBLE END AS profit_factor,
         sum(charge_mw * 0.25) AS total_charged_mwh, sum(discharge_mw * 0.25) AS total_discharged_mwh,
         sum((charge_mw + discharge_mw) * 0.25) AS total_throughput_mwh,
         sum(discharge_mw * 0.25) / any_value(cap) AS equivalent_full_cycles,
         avg(greatest(soc_mwh, 0)) AS average_soc_mwh, min(greatest(soc_mwh, 0)) AS minimum_soc_mwh,
         max(greatest(soc_mwh, 0)) AS maximum_soc_mwh,
         avg(CASE WHEN charge_mw > 1e-6 OR discharge_mw > 1e-6 THEN 100 ELSE 0 END) AS active_interval_percentage,
         avg(CASE WHEN charge_mw > 1e-6 THEN 100 ELSE 0 END) AS charge_interval_percentage,
         avg(CASE WHEN discharge_mw > 1e-6 THEN 100 ELSE 0 END) AS discharge_interval_percentage,
         count(*) FILTER (charge_mw > 1e-6 AND discharge_mw > 1e-6) AS simultaneous_charge_discharge_intervals
  FROM equity GROUP BY 1, 2),
by_day AS (
  SELECT series_id, scenario_id, count(*) AS backtest_days, avg(daily_profit) AS average_daily_profit_usd,
         median(daily_profit) AS median_daily_profit_usd, max(daily_profit) AS best_day_profit_usd,
         min(daily_profit) AS worst_day_profit_usd,
         CASE WHEN stddev_samp(daily_profit) > 0 THEN avg(daily_profit) / stddev_samp(daily_profit) * sqrt(365) END AS annualized_daily_sharpe,
         avg(CASE WHEN daily_profit > 0 THEN 100 ELSE 0 END) AS profitable_day_percentage,
         avg(equivalent_full_cycles) AS average_cycles_per_day
  FROM daily GROUP BY 1, 2),
summary AS (SELECT * FROM by_interval JOIN by_day USING (series_id, scenario_id))"""
WHOLE = {"backtest_start", "backtest_end", "backtest_days", "intervals", "simultaneous_charge_discharge_intervals"}
SUMMARY_SELECT = ", ".join(c if c in WHOLE else r(c) for c in mt.SUMMARY_FIELDS)


@query("rules_summary", f"{RULES_SQL}{SUMMARY_SQL} SELECT series_id, scenario_id, {SUMMARY_SELECT} FROM summary")
def rules_summary(spark, folder):
    """All 25 fields, written as JSON and read back."""
    path = scratch(spark, "summary")
    table = mt.summary(_rules(spark, folder, "time_stamp", "realized_revenue"), OUT)
    tables.write_json(table, path)
    return rounded(spark.read.schema(table.schema).json(path))


@query("action_log_summary", f"{LOG_SQL}{SUMMARY_SQL} SELECT series_id, scenario_id, {SUMMARY_SELECT} FROM summary")
def action_log_summary(spark, folder):
    return rounded(mt.summary(_logged(spark, folder, "time_stamp", "realized_revenue"), OUT))


# --- planned schedules ---------------------------------------------------------


def _planned(spark, folder) -> dict[str, DataFrame]:
    """The three planned schedules, settled, without running profit; the forecast is written for all of them."""
    rows = with_scenarios(durable(fx.forecast(spark, folder)), SCENARIOS)
    return {
        "4-Hour Rolling": settle_schedule(rolling_schedule(rows, KEYS), KEYS, cumulative=False),
        "24-Hour Horizon": settle_schedule(daily_schedule(rows, KEYS), KEYS, cumulative=False),
        "Perfect Foresight": settle_schedule(perfect_foresight(rows, KEYS), KEYS, cumulative=False),
    }


def _schedule(rows):
    return rounded(rows.select(*OUT, "time_stamp", *DISPATCHED))


@query("day_ahead_schedule")
def day_ahead(spark, folder):
    rows = with_scenarios(fx.forecast(spark, folder), SCENARIOS)
    return _schedule(settle_schedule(daily_schedule(rows, KEYS), KEYS))


@query("perfect_foresight_schedule")
def foresight(spark, folder):
    rows = with_scenarios(fx.forecast(spark, folder), SCENARIOS)
    return _schedule(settle_schedule(perfect_foresight(rows, KEYS), KEYS))


@query("rolling_horizon_schedule")
def rolling(spark, folder):
    rows = with_scenarios(fx.forecast(spark, folder), SCENARIOS)
    return _schedule(settle_schedule(rolling_schedule(rows, KEYS), KEYS))


# A battery of eleven levels, one MWh apart, small enough for SQL to try every move: up to
# 3 levels up and 4 down in an interval, from level 4.  Below about -9 per MWh charging and
# discharging at once would pay, so its tables take the all-levels branch too.
COARSE = Battery(
    "coarse", capacity_mwh=20.0, minimum_soc_mwh=10.0, initial_soc_mwh=14.0, max_charge_mw=6.0, max_discharge_mw=2.0,
    charge_efficiency=0.5, discharge_efficiency=0.5, interval_hours=1.0,
)


def _coarse_step(price: str) -> str:
    """Best value of every level one interval earlier, from the values ``v`` after it."""
    return f"""[list_max([CASE WHEN m > l THEN (l - m) * ({price} + 5.5) / 0.5 ELSE (l - m) * ({price} - 5.5) * 0.5 END + v[m + 1]
      FOR m IN range(greatest(0, l - 4), least(10, l + 3) + 1)]) FOR l IN range(11)]"""


def _coarse_days(price: str) -> str:
    return f"""
  SELECT series_id, date, p, n AS t, [CASE WHEN l = 4 THEN 0.0 ELSE -1e18 END::DOUBLE FOR l IN range(11)] AS v
  FROM (SELECT series_id, time_stamp::DATE AS date, list({price} ORDER BY time_stamp) AS p, count(*) AS n FROM forecast GROUP BY 1, 2)
  UNION ALL
  SELECT series_id, date, p, t - 1, {_coarse_step("p[t]")} FROM {price}_days WHERE t > 0"""


@query(
    "coarse_day_optimum",
    f"""WITH RECURSIVE {fx.FORECAST_SQL},
    predicted_days AS ({_coarse_days("predicted")}),
    actual_days AS ({_coarse_days("actual")})
    SELECT d.series_id, d.date, {r('d.v[5]', 'planned_profit', 4)}, {r('f.v[5]', 'foresight_profit', 4)}
    FROM predicted_days d JOIN actual_days f ON d.series_id = f.series_id AND d.date = f.date WHERE d.t = 0 AND f.t = 0""",
)
def coarse_day_optimum(spark, folder):
    """What every day's schedule plans to earn, on forecast and on actual prices, is the optimum over all moves."""
    rows = with_scenarios(durable(fx.forecast(spark, folder)), [COARSE])
    planned = realized_profit(daily_schedule(rows, KEYS), "predicted")
    perfect = realized_profit(perfect_foresight(rows, KEYS))
    totals = [
        f.groupBy("series_id", F.to_date("time_stamp").alias("date")).agg(F.sum("realized_revenue").alias(n))
        for f, n in ((planned, "planned_profit"), (perfect, "foresight_profit"))
    ]
    return rounded(totals[0].join(totals[1], ["series_id", "date"]), digits=4)


@query(
    "coarse_rolling_levels",
    f"""WITH RECURSIVE {fx.FORECAST_SQL},
    numbered AS (
      SELECT series_id, time_stamp, row_number() OVER w AS i,
             list(predicted + sin(pos)) OVER (w ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS p
      FROM forecast WINDOW w AS (PARTITION BY series_id ORDER BY time_stamp)),
    planned AS (
      SELECT series_id, i, p, len(p) AS t, [0.0::DOUBLE FOR l IN range(11)] AS v FROM numbered
      UNION ALL
      SELECT series_id, i, p, t - 1, {_coarse_step("p[t]")} FROM planned WHERE t > 1),
    first_moves AS (
      SELECT series_id, i, [[{{'m': m, 'w': CASE WHEN m > l THEN (l - m) * (p[1] + 5.5) / 0.5 ELSE (l - m) * (p[1] - 5.5) * 0.5 END + v[m + 1]}}
        FOR m IN range(greatest(0, l - 4), least(10, l + 3) + 1)] FOR l IN range(11)] AS c
      FROM planned WHERE t = 1),
    moves AS (
      SELECT series_id, i, [list_min([{{'d': abs(x.m - l), 'm': x.m}} FOR x IN c[l + 1]
        IF x.w >= list_max([y.w FOR y IN c[l + 1]]) - 1e-9]).m FOR l IN range(11)] AS after
      FROM first_moves),
    whole AS (SELECT series_id, list(after ORDER BY i) AS moves, count(*) AS n FROM moves GROUP BY 1),
    walked AS (
      SELECT series_id, moves, n, 0 AS i, 4::BIGINT AS level FROM whole
      UNION ALL
      SELECT series_id, moves, n, i + 1, moves[i + 1][level + 1] FROM walked WHERE i < n)
    SELECT w.series_id, time_stamp, {r('level + 10.0::DOUBLE', 'soc_mwh')} FROM walked w JOIN numbered USING (series_id, i)""",
)
def coarse_rolling_levels(spark, folder):
    """The level after every interval when each re-plans the next 16 and commits its first move.

    Filled-in slots repeat a price, and equal prices leave several best plans; a
    ripple on the forecast makes the best one unique.
    """
    rows = fx.forecast(spark, folder).withColumn("predicted", F.col("predicted") + F.sin(F.col("pos").cast("double")))
    rows = with_scenarios(rows, [COARSE])
    return rounded(rolling_schedule(rows, KEYS).select(*ID, "soc_mwh"))


def _named(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.withColumn("strategy", F.lit(n)) for n, f in frames.items()])


_CHECK_NAMES = ", ".join(f"('{n}')" for n in ("4-Hour Rolling", "24-Hour Horizon", "Perfect Foresight"))


@query(
    "schedule_checks",
    f"""WITH {fx.FORECAST_SQL}
    SELECT series_id, scenario_id, strategy, 0::BIGINT AS below_minimum, 0::BIGINT AS above_capacity,
           0::BIGINT AS simultaneous, count(*) AS intervals, 0.0::DOUBLE AS energy_imbalance
    FROM forecast, (VALUES ('base'), ('small')) s(scenario_id), (VALUES {_CHECK_NAMES}) t(strategy) GROUP BY ALL""",
)
def schedule_checks(spark, folder):
    """Level bounds, exclusive modes and energy balance of every planned schedule."""
    rows = mt.checked(_named(_planned(spark, folder)))
    by = [*OUT, "strategy"]
    stored = F.sum((F.col("charge_mw") * F.col("charge_efficiency") - F.col("discharge_mw") / F.col("discharge_efficiency")) * F.col("interval_hours"))
    # Day schedules start afresh each morning, so sum the day-wise changes.
    changed = F.sum(F.col("soc_mwh") - F.col("soc_start_mwh"))
    balance = rows.groupBy(*by).agg(F.round(stored - changed, 4).alias("energy_imbalance"))
    return mt.schedule_checks(rows, by).join(balance, by).withColumn("energy_imbalance", F.col("energy_imbalance") + 0.0)


@query(
    "foresight_is_ceiling",
    f"""WITH {fx.FORECAST_SQL}
    SELECT series_id, scenario_id, true AS ceiling_holds, true AS no_losing_day
    FROM forecast, (VALUES ('base'), ('small')) s(scenario_id) GROUP BY ALL""",
)
def foresight_is_ceiling(spark, folder):
    """No day schedule earns more than foresight, and foresight never loses a day."""
    rows = with_scenarios(fx.forecast(spark, folder), SCENARIOS)
    day = mt.daily_rollup(settle_schedule(daily_schedule(rows, KEYS), KEYS, cumulative=False), OUT).select(
        *OUT, "date", F.col("daily_profit").alias("planned")
    )
    best = mt.daily_rollup(settle_schedule(perfect_foresight(rows, KEYS), KEYS, cumulative=False), OUT).select(*OUT, "date", "daily_profit")
    return best.join(day, [*OUT, "date"]).groupBy(*OUT).agg(
        F.bool_and(F.col("daily_profit") >= F.col("planned") - 1e-6).alias("ceiling_holds"),
        F.bool_and(F.col("daily_profit") >= -1e-6).alias("no_losing_day"),
    )


@query("horizon_comparison")
def horizon_comparison(spark, folder):
    """Five figures per horizon, and each horizon's share of the ceiling."""
    summaries = mt.summary(_named(_planned(spark, folder)), [*OUT, "strategy"])
    table = durable(reports.strategy_table(summaries, OUT))
    ladder = reports.capture_ladder(table, OUT, "Perfect Foresight").drop("total_profit")
    return rounded(table.join(ladder, [*OUT, "strategy"]))


_COMPARE_SQL = """SELECT series_id, scenario_id, total_profit_usd AS total_profit, annualized_daily_sharpe AS sharpe_ratio,
  maximum_drawdown_usd AS maximum_drawdown, profit_factor, equivalent_full_cycles FROM summary"""


@query(
    "scenario_comparison",
    f"""{RULES_SQL}{SUMMARY_SQL},
    t AS ({_COMPARE_SQL})
    SELECT series_id, arg_max(scenario_id, total_profit) AS best_profit_strategy, {r('max(total_profit)', 'best_profit')},
           arg_max(scenario_id, sharpe_ratio) AS best_sharpe_strategy, {r('max(sharpe_ratio)', 'best_sharpe')},
           arg_min(scenario_id, maximum_drawdown) AS lowest_drawdown_strategy, {r('min(maximum_drawdown)', 'lowest_drawdown')}
    FROM t GROUP BY 1""",
)
def scenario_comparison(spark, folder):
    summaries = mt.summary(_rules(spark, folder, "time_stamp", "realized_revenue"), OUT)
    table = reports.strategy_table(summaries, ["series_id"], "scenario_id")
    return rounded(reports.strategy_winners(table, ["series_id"], [s.scenario_id for s in SCENARIOS], "scenario_id"))


@query(
    "capture_ladder",
    f"""{RULES_SQL}{SUMMARY_SQL},
    t AS ({_COMPARE_SQL}),
    m AS (SELECT *, max(CASE WHEN scenario_id = 'base' THEN total_profit END) OVER (PARTITION BY series_id) AS top FROM t)
    SELECT series_id, scenario_id, {r('total_profit')}, {r('total_profit / top * 100', 'percent_of_ceiling')},
           {r('top - total_profit', 'gap_to_ceiling')} FROM m""",
)
def capture_ladder(spark, folder):
    summaries = mt.summary(_rules(spark, folder, "time_stamp", "realized_revenue"), OUT)
    table = reports.strategy_table(summaries, ["series_id"], "scenario_id")
    return rounded(reports.capture_ladder(table, ["series_id"], "base", "scenario_id"))


# --- reports on a settled schedule ----------------------------------------------


@query(
    "best_day",
    f"""{RULES_SQL}{DAILY_SQL},
    chosen AS (SELECT series_id, scenario_id, date FROM daily
               QUALIFY row_number() OVER (PARTITION BY series_id, scenario_id ORDER BY daily_profit DESC, date) = 1)
    SELECT d.series_id, d.scenario_id, d.time_stamp, c.date AS selected_date, {r('discharge_mw - charge_mw', 'net_dispatch_mw')},
           {r('realized_revenue')}
    FROM dispatch d JOIN chosen c ON d.series_id = c.series_id AND d.scenario_id = c.scenario_id AND d.time_stamp::DATE = c.date""",
)
def best_day(spark, folder):
    kept = _rules(spark, folder, "time_stamp", "realized_revenue").select(*OUT, "time_stamp", "charge_mw", "discharge_mw", "realized_revenue")
    rows = reports.best_day(durable(kept), OUT)
    rows = rows.withColumn("net_dispatch_mw", F.col("discharge_mw") - F.col("charge_mw"))
    return rounded(rows.select(*OUT, "time_stamp", "selected_date", "net_dispatch_mw", "realized_revenue"))


@query(
    "extreme_days",
    f"""{RULES_SQL}{DAILY_SQL}
    SELECT series_id, scenario_id,
           (list(date ORDER BY daily_profit DESC, date))[1] AS best_date, {r('max(daily_profit)', 'best_profit')},
           (list(date ORDER BY daily_profit, date))[1] AS worst_date, {r('min(daily_profit)', 'worst_profit')},
           {r('sum(daily_profit)', 'total_profit')}
    FROM daily GROUP BY 1, 2""",
)
def extreme_days(spark, folder):
    return rounded(reports.extreme_days(mt.daily_rollup(_rules(spark, folder, "time_stamp", "realized_revenue"), OUT), OUT))


@query("action_counts", f"{LOG_SQL} SELECT series_id, scenario_id, action, count(*) AS intervals FROM dispatch GROUP BY 1, 2, 3")
def action_counts(spark, folder):
    return reports.action_counts(_logged(spark, folder, "action"), OUT)


_ACTION_STATS = """,
stats AS (
  SELECT series_id, scenario_id, action, count(*) AS intervals, avg(predicted) AS mean_price, median(predicted) AS median_price,
         stddev_samp(predicted) AS price_std, min(predicted) AS minimum_price, max(predicted) AS maximum_price
  FROM dispatch GROUP BY 1, 2, 3)"""


@query(
    "action_price_summary",
    f"""{LOG_SQL}{_ACTION_STATS}
    SELECT series_id, scenario_id, action, intervals, {", ".join(r(c) for c in ("mean_price", "median_price", "price_std", "minimum_price", "maximum_price"))},
           {r('intervals / sum(intervals) OVER (PARTITION BY series_id, scenario_id) * 100', 'action_percentage')} FROM stats""",
)
def action_price_summary(spark, folder):
    log = durable(_logged(spark, folder, "predicted").select(*OUT, "predicted", "action"))
    return rounded(reports.action_price_summary(log, OUT, "predicted", "action"))


@query(
    "median_spread",
    f"""{LOG_SQL}{_ACTION_STATS}
    SELECT series_id, scenario_id, {r("max(median_price) FILTER (action = 'Charge')", 'charge_median')},
           {r("max(median_price) FILTER (action = 'Hold')", 'hold_median')},
           {r("max(median_price) FILTER (action = 'Discharge')", 'discharge_median')},
           {r("max(median_price) FILTER (action = 'Discharge') - max(median_price) FILTER (action = 'Charge')", 'median_spread')}
    FROM stats GROUP BY 1, 2""",
)
def median_spread(spark, folder):
    log = durable(_logged(spark, folder, "predicted").select(*OUT, "predicted", "action"))
    return rounded(reports.median_spread(reports.action_price_summary(log, OUT, "predicted", "action"), OUT))


def _levels(spark, folder) -> DataFrame:
    """Only what the level reports read, written once: quantiles read their input twice."""
    return durable(_rules(spark, folder, "time_stamp").select(*OUT, "time_stamp", "soc_mwh", "capacity_mwh"))


@query(
    "month_hour_profile",
    f"""{RULES_SQL}
    SELECT scenario_id, month(time_stamp)::INT AS month_number, strftime(time_stamp, '%b') AS month_label, hour(time_stamp)::INT AS hour,
           {r('avg(soc_mwh)', 'average_soc_mwh')}, {r('median(soc_mwh)', 'median_soc_mwh')}, {r('min(soc_mwh)', 'minimum_soc_mwh')},
           {r('max(soc_mwh)', 'maximum_soc_mwh')}, count(*) AS observations, {r('avg(soc_mwh / cap * 100)', 'average_soc_percentage')}
    FROM dispatch GROUP BY 1, 2, 3, 4""",
)
def month_hour_profile(spark, folder):
    return rounded(reports.month_hour_profile(_levels(spark, folder), ["scenario_id"]))


@query(
    "month_hour_grid",
    f"""{RULES_SQL}
    SELECT series_id, scenario_id, month(time_stamp)::INT AS month_number, strftime(time_stamp, '%b') AS month_label,
           {", ".join(r(f"avg(soc_mwh) FILTER (hour(time_stamp) = {h})", f"h{h:02d}") for h in range(24))}
    FROM dispatch GROUP BY 1, 2, 3, 4""",
)
def month_hour_grid(spark, folder):
    profile = reports.month_hour_profile(_levels(spark, folder), OUT)
    return rounded(reports.month_hour_grid(profile, OUT))


@query(
    "month_hour_grids",
    f"""{RULES_SQL},
    long AS (
      SELECT series_id, scenario_id, month(time_stamp)::INT AS month_number, hour(time_stamp) AS hour, unnest([
        {{'grid': 'share', 'v': avg(soc_mwh / cap * 100)}}, {{'grid': 'count', 'v': count(*)::DOUBLE}}]) AS x
      FROM dispatch GROUP BY 1, 2, 3, 4)
    SELECT series_id, scenario_id, month_number, x.grid AS grid,
           {", ".join(r(f"max(x.v) FILTER (hour = {h})", f"h{h:02d}") for h in range(24))}
    FROM long GROUP BY 1, 2, 3, 4""",
)
def month_hour_grids(spark, folder):
    """Share of capacity and number of rows per month and hour."""
    profile = durable(reports.month_hour_profile(_levels(spark, folder), OUT))
    kinds = {"share": "average_soc_percentage", "count": "observations"}
    grids = [
        reports.month_hour_grid(profile.withColumn("_x", F.col(c).cast("double")), OUT, "_x").withColumn("grid", F.lit(g))
        for g, c in kinds.items()
    ]
    return rounded(grids[0].unionByName(grids[1]).drop("month_label"))


@query(
    "earliest_slots",
    f"""{RULES_SQL}
    SELECT scenario_id, month(time_stamp)::INT AS month_number, hour(time_stamp)::INT AS hour, {r('avg(soc_mwh)', 'average_soc_mwh')}
    FROM dispatch GROUP BY 1, 2, 3 ORDER BY month_number, hour, scenario_id LIMIT 10""",
)
def earliest_slots(spark, folder):
    """Head of the profile sorted by month and hour."""
    profile = reports.month_hour_profile(_levels(spark, folder), ["scenario_id"])
    rows = reports.earliest_slots(profile, ["scenario_id"], 10)
    return rounded(rows.select("scenario_id", "month_number", "hour", "average_soc_mwh"))


@query(
    "hourly_extremes",
    f"""{RULES_SQL},
    h AS (SELECT series_id, scenario_id, hour(time_stamp)::INT AS hour, avg(soc_mwh) AS m, min(soc_mwh) AS lo, max(soc_mwh) AS hi,
                 sum(soc_mwh) AS s, count(*) AS n FROM dispatch GROUP BY 1, 2, 3)
    SELECT series_id, scenario_id, (list(hour ORDER BY m DESC, hour))[1] AS highest_hour, {r('max(m)', 'highest_value')},
           (list(hour ORDER BY m, hour))[1] AS lowest_hour, {r('min(m)', 'lowest_value')}, {r('sum(s) / sum(n)', 'average_value')},
           {r('min(lo)', 'minimum_value')}, {r('max(hi)', 'maximum_value')}
    FROM h GROUP BY 1, 2""",
)
def hourly_extremes(spark, folder):
    return rounded(reports.hourly_extremes(_rules(spark, folder, "time_stamp"), OUT))


@query(
    "duration_curve",
    f"""{LOG_SQL}
    SELECT series_id, scenario_id, time_stamp, strftime(time_stamp, '%b %d, %Y %H:%M') AS time_text, {r('discharge_mw - charge_mw', 'net_dispatch_mw')},
           CASE WHEN discharge_mw - charge_mw > 1e-6 THEN 'Discharge' WHEN discharge_mw - charge_mw < -1e-6 THEN 'Charge' ELSE 'Idle' END AS operating_state,
           {r('(row_number() OVER (PARTITION BY series_id, scenario_id ORDER BY round(discharge_mw - charge_mw, 6) DESC, time_stamp) - 1) / (count(*) OVER (PARTITION BY series_id, scenario_id) - 1) * 100', 'duration_percentile')}
    FROM dispatch""",
)
def duration_curve(spark, folder):
    rows = _logged(spark, folder, "time_stamp")
    rows = rows.withColumn("net", F.round(F.col("discharge_mw") - F.col("charge_mw"), 6))
    curve = reports.duration_curve(rows, OUT, "net")
    return rounded(
        curve.select(*ID[:1], "scenario_id", "time_stamp", time_text("time_stamp").alias("time_text"), "net_dispatch_mw", "operating_state", "duration_percentile")
    )


@query(
    "state_shares",
    f"""{LOG_SQL},
    s AS (SELECT series_id, scenario_id, CASE WHEN discharge_mw - charge_mw > 1e-6 THEN 'Discharge'
                 WHEN discharge_mw - charge_mw < -1e-6 THEN 'Charge' ELSE 'Idle' END AS st FROM dispatch)
    SELECT series_id, scenario_id, operating_state, {r('avg(CASE WHEN st = operating_state THEN 100 ELSE 0 END)', 'share_percent')}
    FROM s, (VALUES ('Discharge'), ('Idle'), ('Charge')) t(operating_state) GROUP BY 1, 2, 3""",
)
def state_shares(spark, folder):
    return rounded(reports.state_shares(_logged(spark, folder, "pos"), OUT))


@query(
    "duration_statistics",
    f"""{LOG_SQL},
    s AS (SELECT series_id, scenario_id, discharge_mw - charge_mw AS n FROM dispatch)
    SELECT series_id, scenario_id, count(*) AS observation_count,
           {r('avg(CASE WHEN n > 1e-6 THEN 100 ELSE 0 END)', 'discharge_share_percent')},
           {r('avg(CASE WHEN abs(n) <= 1e-6 THEN 100 ELSE 0 END)', 'idle_share_percent')},
           {r('avg(CASE WHEN n < -1e-6 THEN 100 ELSE 0 END)', 'charge_share_percent')},
           {r('max(n)', 'peak_discharge_mw')}, {r('min(n)', 'peak_charge_mw')}, {r('avg(abs(n))', 'mean_absolute_dispatch_mw')}
    FROM s GROUP BY 1, 2""",
)
def duration_statistics(spark, folder):
    return rounded(reports.duration_statistics(_logged(spark, folder, "pos"), OUT))
