"""Queries that compare and align the strategies, held against SQL that tries every move.

All strategies run the coarse battery of eleven levels.  A small ripple on forecast and
actual prices makes every best plan unique, so whole schedules can be compared.  The rule
strategy trades only in slots with readings; the others on the complete grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidewatt.operators import metrics as mt
from tidewatt.operators.positions import number_rows
from tidewatt.operators.schedule import daily_schedule, perfect_foresight, rolling_schedule, settle_schedule
from tidewatt.operators.settle import cumulative_profit
from tidewatt.plans import reports
from tidewatt.plans.rules import rules_backtest
from tidewatt.registry import fixtures as fx
from tidewatt.registry.base import query, r, rounded
from tidewatt.registry.dispatch import COARSE, KEYS, _coarse_step
from tidewatt.registry.windows import ID, THRESHOLD_SQL, W
from tidewatt.session import durable
from tidewatt.settings import with_scenarios

# Report column of each strategy, in order of the ladder.
STRATEGIES = {"perfect": "Perfect Foresight", "day": "24-Hour Horizon", "rolling": "4-Hour Rolling", "rules": "Rules"}
ALIGNED = ["rules", "day", "rolling"]


def rippled(spark, folder) -> DataFrame:
    wave = F.col("pos").cast("double")
    return fx.forecast(spark, folder).withColumns(
        {"predicted": F.col("predicted") + F.sin(wave), "actual": F.col("actual") + F.cos(wave)}
    )


def _rules_on_readings(spark, folder, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rule strategy on the slots that hold readings, numbered without the gaps between them."""
    slots = fx.price_slots(spark, folder).select(*fx.SERIES, "time_stamp")
    held = rows.drop("pos").join(slots, [*fx.SERIES, "time_stamp"], "left_semi")
    numbered = durable(number_rows(held, fx.SERIES, ["time_stamp"]))
    return rules_backtest(numbered, fx.SERIES, [COARSE], columns=columns)


def _settled(spark, folder, names: list[str]) -> dict[str, DataFrame]:
    """The named strategies' settled schedules, without running profit."""
    rows = durable(rippled(spark, folder))
    planned = with_scenarios(rows, [COARSE])
    make = {
        "perfect": lambda: settle_schedule(perfect_foresight(planned, KEYS), KEYS, cumulative=False),
        "day": lambda: settle_schedule(daily_schedule(planned, KEYS), KEYS, cumulative=False),
        "rolling": lambda: settle_schedule(rolling_schedule(planned, KEYS), KEYS, cumulative=False),
        "rules": lambda: _rules_on_readings(spark, folder, rows, ["time_stamp", "realized_revenue"]),
    }
    return {n: make[n]() for n in names}


# --- the same in SQL ---------------------------------------------------------


def _best_moves(v: str, p: str) -> str:
    """For every level the best next level by price ``p`` and the values ``v`` after it; the smaller move of equal ones."""
    reward = f"CASE WHEN m > l THEN (l - m) * ({p} + 5.5) / 0.5 ELSE (l - m) * ({p} - 5.5) * 0.5 END + {v}[m + 1]"
    tried = f"[{{'m': m, 'w': {reward}}} FOR m IN range(greatest(0, l - 4), least(10, l + 3) + 1)]"
    return f"""[list_min([{{'d': abs(x.m - l), 'm': x.m}} FOR x IN {tried}
      IF x.w >= list_max([y.w FOR y IN {tried}]) - 1e-9]).m FOR l IN range(11)]"""


def _days(name: str, price: str) -> str:
    return f""",
{name}_values AS (
  SELECT series_id, date, p, stamps, n AS t, [CASE WHEN l = 4 THEN 0.0 ELSE -1e18 END::DOUBLE FOR l IN range(11)] AS v
  FROM (SELECT series_id, time_stamp::DATE AS date, list({price} ORDER BY time_stamp) AS p, list(time_stamp ORDER BY time_stamp) AS stamps,
               count(*) AS n FROM rippled GROUP BY 1, 2)
  UNION ALL
  SELECT series_id, date, p, stamps, t - 1, {_coarse_step("p[t]")} FROM {name}_values WHERE t > 0),
{name}_moves AS (
  SELECT series_id, date, any_value(stamps) AS stamps, list({_best_moves("v", "p[t]")} ORDER BY t) AS moves, count(*) AS n
  FROM {name}_values WHERE t > 0 GROUP BY 1, 2),
{name}_walk AS (
  SELECT series_id, date, stamps, moves, n, 0::BIGINT AS i, 4::BIGINT AS before, 4::BIGINT AS level FROM {name}_moves
  UNION ALL
  SELECT series_id, date, stamps, moves, n, i + 1, level, moves[i + 1][level + 1] FROM {name}_walk WHERE i < n),
{name}_levels AS (
  SELECT series_id, stamps[i] AS time_stamp, 10.0 + before AS soc_start_mwh, 10.0 + level AS soc_mwh FROM {name}_walk WHERE i > 0)"""


_RULES = THRESHOLD_SQL.replace("FROM forecast", "FROM held") + """,
rule_steps AS (
  SELECT series_id, list(CASE request WHEN 'charge' THEN 3.0 WHEN 'discharge' THEN -4.0 ELSE 0 END::DOUBLE ORDER BY time_stamp) AS steps,
         list(time_stamp ORDER BY time_stamp) AS stamps
  FROM signals GROUP BY 1),
rule_walk AS (
  SELECT series_id, steps, stamps, 0::BIGINT AS i, 14.0::DOUBLE AS before, 14.0::DOUBLE AS level FROM rule_steps
  UNION ALL
  SELECT series_id, steps, stamps, i + 1, level, least(20, greatest(10, level + steps[i + 1])) FROM rule_walk WHERE i < len(steps)),
rules_levels AS (
  SELECT series_id, stamps[i] AS time_stamp, before AS soc_start_mwh, level AS soc_mwh FROM rule_walk WHERE i > 0)"""

_ROLLING = f""",
ahead AS (
  SELECT series_id, time_stamp, row_number() OVER w AS i, list(predicted) OVER (w ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS p
  FROM rippled WINDOW w AS (PARTITION BY series_id ORDER BY time_stamp)),
ahead_values AS (
  SELECT series_id, i, p, len(p) AS t, [0.0::DOUBLE FOR l IN range(11)] AS v FROM ahead
  UNION ALL
  SELECT series_id, i, p, t - 1, {_coarse_step("p[t]")} FROM ahead_values WHERE t > 1),
first_moves AS (SELECT series_id, i, {_best_moves("v", "p[1]")} AS best FROM ahead_values WHERE t = 1),
rolling_moves AS (SELECT series_id, list(best ORDER BY i) AS moves, count(*) AS n FROM first_moves GROUP BY 1),
rolling_walk AS (
  SELECT series_id, moves, n, 0::BIGINT AS i, 4::BIGINT AS before, 4::BIGINT AS level FROM rolling_moves
  UNION ALL
  SELECT series_id, moves, n, i + 1, level, moves[i + 1][level + 1] FROM rolling_walk WHERE i < n),
rolling_levels AS (
  SELECT series_id, time_stamp, 10.0 + before AS soc_start_mwh, 10.0 + level AS soc_mwh FROM rolling_walk JOIN ahead USING (series_id, i))"""


def _settled_sql(names: list[str]) -> str:
    levels = {"perfect": _days("perfect", "actual"), "day": _days("day", "predicted"), "rolling": _ROLLING, "rules": _RULES}
    union = " UNION ALL ".join(f"SELECT '{n}' AS strategy, * FROM {n}_levels" for n in names)
    return f"""WITH RECURSIVE {fx.FORECAST_SQL},
rippled AS MATERIALIZED (
  SELECT series_id, time_stamp, actual + cos(pos) AS actual, predicted + sin(pos) AS predicted FROM forecast),
held AS (SELECT * FROM rippled SEMI JOIN slots USING (series_id, time_stamp)){"".join(levels[n] for n in names)},
powered AS (
  SELECT l.*, actual, greatest(soc_mwh - soc_start_mwh, 0) / 0.5 AS charge_mw, greatest(soc_start_mwh - soc_mwh, 0) * 0.5 AS discharge_mw
  FROM ({union}) l JOIN rippled USING (series_id, time_stamp)),
settled AS MATERIALIZED (
  SELECT *, (discharge_mw - charge_mw) * actual - 5.5 * (charge_mw + discharge_mw) AS realized_revenue FROM powered),
equity AS MATERIALIZED (
  SELECT *, sum(realized_revenue) OVER (PARTITION BY strategy, series_id ORDER BY time_stamp ROWS UNBOUNDED PRECEDING) AS cumulative_profit
  FROM settled)"""


# --- whole schedules -----------------------------------------------------------


@query(
    "coarse_schedules",
    f"""{_settled_sql(list(STRATEGIES))}
    SELECT strategy, series_id, time_stamp, {r('soc_mwh')}, {r('charge_mw')}, {r('discharge_mw')}, {r('realized_revenue')},
           {r('cumulative_profit')} FROM equity""",
)
def coarse_schedules(spark, folder):
    """Every strategy's levels, power, revenue and running profit."""
    rows = [
        cumulative_profit(f, KEYS).select(
            F.lit(n).alias("strategy"), *ID, "soc_mwh", "charge_mw", "discharge_mw", "realized_revenue", "cumulative_profit"
        )
        for n, f in _settled(spark, folder, list(STRATEGIES)).items()
    ]
    return rounded(reduce(DataFrame.unionByName, rows))


# --- alignment -------------------------------------------------------------------


def _interpolated(c: str) -> str:
    return f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN p_{c} IS NULL THEN nv_{c} WHEN n_{c} IS NULL THEN pv_{c}
      ELSE pv_{c} + (nv_{c} - pv_{c}) * (i - p_{c}) / (n_{c} - p_{c}) END"""


def _around(c: str) -> str:
    back, on = f"{W} ROWS UNBOUNDED PRECEDING", f"{W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"""max(CASE WHEN {c} IS NOT NULL THEN i END) OVER ({back}) AS p_{c}, last_value({c} IGNORE NULLS) OVER ({back}) AS pv_{c},
      min(CASE WHEN {c} IS NOT NULL THEN i END) OVER ({on}) AS n_{c}, first_value({c} IGNORE NULLS) OVER ({on}) AS nv_{c}"""


_ALIGNED = f"""{_settled_sql(ALIGNED)},
joined AS (
  SELECT series_id, time_stamp, {", ".join(f"max(cumulative_profit) FILTER (strategy = '{c}') AS {c}" for c in ALIGNED)}
  FROM equity GROUP BY 1, 2),
counted AS (SELECT *, row_number() OVER ({W}) - 1 AS i FROM joined),
around AS (SELECT *, {", ".join(map(_around, ALIGNED))} FROM counted),
aligned AS (SELECT series_id, time_stamp, {", ".join(f"{_interpolated(c)} AS {c}" for c in ALIGNED)} FROM around)"""


def _aligned(spark, folder) -> DataFrame:
    frames = {n: cumulative_profit(f, KEYS) for n, f in _settled(spark, folder, ALIGNED).items()}
    return reports.align_profits(frames, ["series_id"])


@query("aligned_profits", f"{_ALIGNED} SELECT series_id, time_stamp, {', '.join(r(c, digits=5) for c in ALIGNED)} FROM aligned")
def aligned_profits(spark, folder):
    """Running profit of rules, 24-hour and rolling schedules on one time axis, gaps filled."""
    return rounded(_aligned(spark, folder).select(*ID, *ALIGNED), digits=5)


@query(
    "profit_endpoints",
    f"""{_ALIGNED},
    l AS ({" UNION ALL ".join(f"SELECT series_id, time_stamp, '{c}' AS strategy, {c} AS v FROM aligned" for c in ALIGNED)})
    SELECT series_id, strategy, {r('arg_max(v, time_stamp)', 'final_value', 5)}, {r('max(v)', 'peak_value', 5)},
           (list(time_stamp ORDER BY round(v, 6) DESC, time_stamp))[1] AS peak_time, {r('min(v)', 'lowest_value', 5)},
           greatest(1, datesub('day', min(time_stamp), max(time_stamp))) AS period_days
    FROM l GROUP BY 1, 2""",
)
def profit_endpoints(spark, folder):
    return rounded(reports.profit_endpoints(_aligned(spark, folder), ["series_id"], ALIGNED), digits=5)


# --- comparison ------------------------------------------------------------------

_NAMED = " ".join(f"WHEN '{n}' THEN '{title}'" for n, title in STRATEGIES.items())
_TABLE = f"""{_settled_sql(list(STRATEGIES))},
peaks AS (
  SELECT *, max(cumulative_profit) OVER (PARTITION BY strategy, series_id ORDER BY time_stamp ROWS UNBOUNDED PRECEDING) AS peak FROM equity),
by_interval AS (
  SELECT series_id, strategy, sum(realized_revenue) AS total_profit, max(peak - cumulative_profit) AS maximum_drawdown,
         CASE WHEN min(realized_revenue) < 0 THEN sum(greatest(realized_revenue, 0)) / -sum(least(realized_revenue, 0))
              WHEN max(realized_revenue) > 0 THEN 'inf'::DOUBLE END AS profit_factor,
         sum(discharge_mw) / 20 AS equivalent_full_cycles
  FROM peaks GROUP BY 1, 2),
by_day AS (
  SELECT series_id, strategy, CASE WHEN stddev_samp(p) > 0 THEN avg(p) / stddev_samp(p) * sqrt(365) END AS sharpe_ratio
  FROM (SELECT series_id, strategy, time_stamp::DATE, sum(realized_revenue) AS p FROM equity GROUP BY 1, 2, 3) GROUP BY 1, 2),
figures AS (
  SELECT series_id, CASE strategy {_NAMED} END AS strategy, * EXCLUDE (series_id, strategy)
  FROM by_interval JOIN by_day USING (series_id, strategy))"""


def _table(spark, folder) -> DataFrame:
    """Five figures of every strategy and series."""
    frames = _settled(spark, folder, list(STRATEGIES))
    named = [
        f.select(
            F.lit(STRATEGIES[n]).alias("strategy"), *ID, "pos", "charge_mw", "discharge_mw", "soc_mwh", "realized_revenue",
            "interval_hours", "capacity_mwh",
        )
        for n, f in frames.items()
    ]
    rows = reduce(DataFrame.unionByName, named)
    return durable(reports.strategy_table(mt.summary(rows, ["series_id", "strategy"]), ["series_id"]))


@query(
    "strategy_comparison",
    f"""{_TABLE},
    listed AS (SELECT *, list_position([{", ".join(f"'{t}'" for t in STRATEGIES.values())}], strategy) AS o FROM figures)
    SELECT series_id, (list(strategy ORDER BY total_profit DESC, o))[1] AS best_profit_strategy, {r('max(total_profit)', 'best_profit')},
           (list(strategy ORDER BY sharpe_ratio DESC NULLS LAST, o))[1] AS best_sharpe_strategy, {r('max(sharpe_ratio)', 'best_sharpe')},
           (list(strategy ORDER BY maximum_drawdown, o))[1] AS lowest_drawdown_strategy, {r('min(maximum_drawdown)', 'lowest_drawdown')}
    FROM listed GROUP BY 1""",
)
def strategy_comparison(spark, folder):
    """The winners among foresight, planned and rule strategies."""
    return rounded(reports.strategy_winners(_table(spark, folder), ["series_id"], list(STRATEGIES.values())))


@query(
    "strategy_ladder",
    f"""{_TABLE},
    topped AS (SELECT *, max(CASE WHEN strategy = 'Perfect Foresight' THEN total_profit END) OVER (PARTITION BY series_id) AS top FROM figures)
    SELECT series_id, strategy, {", ".join(r(c) for c in ("total_profit", "sharpe_ratio", "maximum_drawdown", "profit_factor", "equivalent_full_cycles"))},
           {r('total_profit / nullif(top, 0) * 100', 'percent_of_ceiling')}, {r('top - total_profit', 'gap_to_ceiling')}
    FROM topped""",
)
def strategy_ladder(spark, folder):
    """Five figures of every strategy, and its share of what perfect foresight earns."""
    table = _table(spark, folder)
    ladder = reports.capture_ladder(table, ["series_id"], "Perfect Foresight").drop("total_profit")
    return rounded(table.join(ladder, ["series_id", "strategy"]))
