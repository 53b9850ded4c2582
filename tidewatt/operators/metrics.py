"""Error metrics, daily tables and the summary of a settled schedule."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from tidewatt.functions.scalars import iso_text, ratio
from tidewatt.operators.blocks import running_totals
from tidewatt.session import attach, durable
from tidewatt.settings import BLOCK_ROWS

# Power above this many MW counts as activity.
ACTIVE_MW = 1e-6


def residuals(df: DataFrame) -> DataFrame:
    return df.withColumn("error", F.col("actual") - F.col("predicted")).withColumn(
        "absolute_error", F.abs("error")
    )


def error_metrics(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R2 per key, in one pass with partial aggregation."""
    e = F.col("actual") - F.col("predicted")
    spread = F.var_pop("actual") * F.count("actual")
    return df.groupBy(*(keys or [])).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.when(spread > 0, spread)).alias("r2"),
    )


def rank_models(metrics: DataFrame, metric: str = "rmse", lower_is_better: bool = True) -> DataFrame:
    """Comparison table, best model first."""
    return metrics.orderBy(F.col(metric).asc() if lower_is_better else F.col(metric).desc(), "model")


def best_model(metrics: DataFrame, metric: str = "rmse", lower_is_better: bool = True) -> DataFrame:
    return rank_models(metrics, metric, lower_is_better).limit(1)


def monthly_errors(df: DataFrame, keys: list[str], ts: str = "time_stamp") -> DataFrame:
    e = F.col("actual") - F.col("predicted")
    return (
        df.groupBy(*keys, F.date_format(ts, "yyyy-MM").alias("year_month"))
        .agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.min(ts).alias("_t"))
        .select(
            *keys,
            "year_month",
            F.date_format("_t", "MMM").alias("month_label"),
            "mae",
            "mse",
            F.sqrt("mse").alias("rmse"),
        )
    )


def _energy() -> tuple[Column, Column]:
    return F.col("charge_mw") * F.col("interval_hours"), F.col("discharge_mw") * F.col("interval_hours")


def _daily_aggregates() -> list[Column]:
    charged, discharged = _energy()
    return [
        F.sum("realized_revenue").alias("daily_profit"),
        F.sum(charged).alias("charged_mwh"),
        F.sum(discharged).alias("discharged_mwh"),
        F.sum(charged + discharged).alias("throughput_mwh"),
        F.avg("soc_mwh").alias("average_soc_mwh"),
        F.min("soc_mwh").alias("minimum_soc_mwh"),
        F.max("soc_mwh").alias("maximum_soc_mwh"),
        F.count_if(F.col("charge_mw") > ACTIVE_MW).alias("charge_intervals"),
        (F.sum(discharged) / F.first("capacity_mwh")).alias("equivalent_full_cycles"),
    ]


def daily_rollup(df: DataFrame, keys: list[str], ts: str = "time_stamp") -> DataFrame:
    """One row per day with energy, level and profit, before running values."""
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(*_daily_aggregates())


def drawdown(
    df: DataFrame, keys: list[str], profit: str, pos: str, cumulative: str = "cumulative_profit", size: int = BLOCK_ROWS
) -> DataFrame:
    """Running profit, its running peak (from the first value on) and the gap, in one pass over the rows.

    Blocks are accumulated on their own and written; their totals and inner peaks
    make a small table whose running values then lift every row of a block.
    """
    block = Window.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumn("_b", F.floor(F.col(pos) / size)).withColumn("_sum", F.sum(profit).over(block))
    inside = durable(inside.withColumn("_top", F.max("_sum").over(block)))
    blocks = inside.groupBy(*keys, "_b").agg(F.sum(profit).alias("_total"), F.max("_sum").alias("_peak"))
    carried = running_totals(blocks, keys, {"_carry": ("sum", "_total")}, "_b", size, inclusive=False)
    lifted = carried.withColumn("_peak", F.col("_peak") + F.coalesce("_carry", F.lit(0.0)))
    before = running_totals(lifted, keys, {"_before": ("max", "_peak")}, "_b", size, inclusive=False)
    base = F.coalesce("_carry", F.lit(0.0))
    rows = attach(inside, before.select(*keys, "_b", "_carry", "_before"), [*keys, "_b"])
    return (
        rows.withColumn(cumulative, F.coalesce(F.col("_sum") + base, F.col("_carry")))
        .withColumn("running_peak", F.greatest(F.col("_top") + base, "_before"))
        .withColumn("drawdown", F.col(cumulative) - F.col("running_peak"))
        .drop("_b", "_sum", "_top", "_carry", "_before")
    )


def daily_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """The daily rollup with cumulative profit, running peak and drawdown."""
    days = daily_rollup(df, keys).withColumn("_day", F.unix_date("date").cast("bigint"))
    frame = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    # A series has one row per calendar day here, so one task holds it easily.
    return (
        days.withColumn("cumulative_profit", F.sum("daily_profit").over(frame))
        .withColumn("running_peak", F.max("cumulative_profit").over(frame))
        .withColumn("drawdown", F.col("cumulative_profit") - F.col("running_peak"))
        .drop("_day")
    )


def profit_factor(revenue: Column) -> Column:
    gains = F.sum(F.when(revenue > 0, revenue).otherwise(F.lit(0.0)))
    losses = -F.sum(F.when(revenue < 0, revenue).otherwise(F.lit(0.0)))
    return ratio(gains, losses)


def sharpe(profit: Column) -> Column:
    """Annualised ratio of daily profit, null when it does not vary."""
    deviation = F.stddev_samp(profit)
    return F.when(deviation > 0, F.avg(profit) / deviation * F.sqrt(F.lit(365.0)))


def _day_parts(df: DataFrame, keys: list[str], pos: str, ts: str) -> DataFrame:
    """Per day: the daily figures plus mergeable parts of the interval figures.

    Running profit inside the day uses the same partitioning as the rollup,
    so interval rows shuffle once and everything after works on days.
    """
    inside = Window.partitionBy(*keys, "date").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    charging, discharging = F.col("charge_mw") > ACTIVE_MW, F.col("discharge_mw") > ACTIVE_MW
    revenue, level = F.col("realized_revenue"), F.greatest(F.col("soc_mwh"), F.lit(0.0))
    rows = df.select(
        *keys, pos, ts, "charge_mw", "discharge_mw", "soc_mwh", "realized_revenue", "interval_hours", "capacity_mwh",
        F.to_date(ts).alias("date"),
    )
    rows = rows.withColumn("_e", F.sum("realized_revenue").over(inside))
    rows = rows.withColumn("_peak", F.max("_e").over(inside))
    return rows.groupBy(*keys, "date").agg(
        *_daily_aggregates(),
        F.min(ts).alias("_start"),
        F.max(ts).alias("_end"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(revenue > 0, revenue).otherwise(F.lit(0.0))).alias("_gains"),
        F.sum(F.when(revenue < 0, -revenue).otherwise(F.lit(0.0))).alias("_losses"),
        F.sum(level).alias("_level"),
        F.min(level).alias("_level_min"),
        F.max(level).alias("_level_max"),
        F.count_if(charging | discharging).alias("_active"),
        F.count_if(charging).alias("_charging"),
        F.count_if(discharging).alias("_discharging"),
        F.count_if(charging & discharging).alias("_both"),
        F.max("_e").alias("_high"),
        F.min("_e").alias("_low"),
        F.min(F.col("_e") - F.col("_peak")).alias("_fall"),
    )


# The summary's fields in their order.
SUMMARY_FIELDS = [
    "backtest_start", "backtest_end", "backtest_days", "intervals",
    "total_profit_usd", "average_daily_profit_usd", "median_daily_profit_usd",
    "best_day_profit_usd", "worst_day_profit_usd",
    "annualized_daily_sharpe", "maximum_drawdown_usd", "profit_factor", "profitable_day_percentage",
    "total_charged_mwh", "total_discharged_mwh", "total_throughput_mwh",
    "equivalent_full_cycles", "average_cycles_per_day",
    "average_soc_mwh", "minimum_soc_mwh", "maximum_soc_mwh",
    "active_interval_percentage", "charge_interval_percentage", "discharge_interval_percentage",
    "simultaneous_charge_discharge_intervals",
]


def summary(df: DataFrame, keys: list[str], pos: str = "pos", ts: str = "time_stamp") -> DataFrame:
    """One row of 25 fields per key.

    The largest fall of interval equity is chained over days: a day is known
    by its total, its highest and lowest point and its largest inner fall.
    """
    days = _day_parts(df, keys, pos, ts)
    earlier = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_open", F.coalesce(F.sum("daily_profit").over(earlier), F.lit(0.0)))
    days = days.withColumn("_before", F.max(F.col("_open") + F.col("_high")).over(earlier))
    fall = F.least(F.col("_fall"), F.col("_open") + F.col("_low") - F.col("_before"))
    profit = F.col("daily_profit")
    return (
        days.groupBy(*keys)
        .agg(
            iso_text(F.min("_start")).alias("backtest_start"),
            iso_text(F.max("_end")).alias("backtest_end"),
            F.count(F.lit(1)).alias("backtest_days"),
            F.sum("_n").alias("intervals"),
            F.sum(profit).alias("total_profit_usd"),
            F.avg(profit).alias("average_daily_profit_usd"),
            F.median(profit).alias("median_daily_profit_usd"),
            F.max(profit).alias("best_day_profit_usd"),
            F.min(profit).alias("worst_day_profit_usd"),
            sharpe(profit).alias("annualized_daily_sharpe"),
            F.abs(F.min(fall)).alias("maximum_drawdown_usd"),
            ratio(F.sum("_gains"), F.sum("_losses")).alias("profit_factor"),
            (F.avg((profit > 0).cast("double")) * 100).alias("profitable_day_percentage"),
            F.sum("charged_mwh").alias("total_charged_mwh"),
            F.sum("discharged_mwh").alias("total_discharged_mwh"),
            F.sum("throughput_mwh").alias("total_throughput_mwh"),
            F.sum("equivalent_full_cycles").alias("equivalent_full_cycles"),
            F.avg("equivalent_full_cycles").alias("average_cycles_per_day"),
            (F.sum("_level") / F.sum("_n")).alias("average_soc_mwh"),
            F.min("_level_min").alias("minimum_soc_mwh"),
            F.max("_level_max").alias("maximum_soc_mwh"),
            (F.sum("_active") / F.sum("_n") * 100).alias("active_interval_percentage"),
            (F.sum("_charging") / F.sum("_n") * 100).alias("charge_interval_percentage"),
            (F.sum("_discharging") / F.sum("_n") * 100).alias("discharge_interval_percentage"),
            F.sum("_both").alias("simultaneous_charge_discharge_intervals"),
        )
        .select(*keys, *SUMMARY_FIELDS)
    )


def schedule_checks(df: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Counts of rows that break a physical rule; every count must be zero."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col("soc_mwh") < F.col("minimum_soc_mwh") - tolerance).alias("below_minimum"),
        F.count_if(F.col("soc_mwh") > F.col("capacity_mwh") + tolerance).alias("above_capacity"),
        F.count_if((F.col("charge_mw") > tolerance) & (F.col("discharge_mw") > tolerance)).alias("simultaneous"),
        F.count(F.lit(1)).alias("intervals"),
    )


def require_clean(checks: DataFrame) -> None:
    """Raise when any schedule breaks a rule; looks at one offending key only."""
    bad = checks.filter("below_minimum + above_capacity + simultaneous > 0").limit(1).collect()
    if bad:
        raise ValueError(f"schedule breaks a physical rule: {bad[0].asDict()}")


def broken_rules(tolerance: float = 1e-6) -> dict[str, Column]:
    """Physical rules that one row of a schedule can break, by name.

    Power and levels come from different steps of a plan or from outside, so
    each is held against the battery and against the other.  A level or power
    that is null or NaN breaks ``missing`` alone.
    """
    level, start, up, down = (F.col(c) for c in ("soc_mwh", "soc_start_mwh", "charge_mw", "discharge_mw"))
    hours = F.col("interval_hours")
    stored = up * hours * F.col("charge_efficiency") - down * hours / F.col("discharge_efficiency")
    gone = [c.isNull() | F.isnan(c) for c in (level, start, up, down)]
    whole = ~(gone[0] | gone[1] | gone[2] | gone[3])
    return {
        "missing": ~whole,
        "below_minimum": whole & (F.least(level, start) < F.col("minimum_soc_mwh") - tolerance),
        "above_capacity": whole & (F.greatest(level, start) > F.col("capacity_mwh") + tolerance),
        "simultaneous": whole & (up > tolerance) & (down > tolerance),
        "negative_power": whole & (F.least(up, down) < -tolerance),
        "over_power": whole & ((up > F.col("max_charge_mw") + tolerance) | (down > F.col("max_discharge_mw") + tolerance)),
        "unbalanced": whole & (F.abs(level - start - stored) > tolerance),
    }


def checked(df: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """A written copy of a schedule, refused with ValueError when a row breaks a physical rule.

    The counts are observed while the rows are written, so the check takes no
    pass of its own.  A row counts once for every rule that it breaks; a task
    that runs twice may count its rows twice.
    """
    seen = Observation(f"rules-{uuid.uuid4().hex}")
    counts = [F.count_if(rule).alias(name) for name, rule in broken_rules(tolerance).items()]
    written = durable(df.observe(seen, *counts))
    bad = {name: n for name, n in seen.get.items() if n}
    if bad:
        raise ValueError(f"schedule breaks physical rules: {bad}")
    return written
