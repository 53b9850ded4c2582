"""Settlement of schedules: power, costs, revenue and running profit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatt.operators.blocks import running

# Power below this many MW is numerical noise, not an action.
NOISE_MW = 1e-9


def feasible_charge(soc: Column | str = "soc_start_mwh") -> Column:
    """Largest charging power that the room left in the store allows."""
    room = (F.col("capacity_mwh") - _c(soc)) / (F.col("charge_efficiency") * F.col("interval_hours"))
    return F.greatest(F.lit(0.0), F.least(F.col("max_charge_mw"), room))


def feasible_discharge(soc: Column | str = "soc_start_mwh") -> Column:
    """Largest discharging power that the stored energy allows."""
    stock = (_c(soc) - F.col("minimum_soc_mwh")) * F.col("discharge_efficiency") / F.col("interval_hours")
    return F.greatest(F.lit(0.0), F.least(F.col("max_discharge_mw"), stock))


def requested_energy(request: Column | str) -> Column:
    """Signed change of stored energy when the request is met in full."""
    charge = F.col("max_charge_mw") * F.col("charge_efficiency") * F.col("interval_hours")
    discharge = F.col("max_discharge_mw") / F.col("discharge_efficiency") * F.col("interval_hours")
    wish = _c(request)
    return F.when(wish == "charge", charge).when(wish == "discharge", -discharge).otherwise(F.lit(0.0))


def apply_request(df: DataFrame, request: str = "request", action: str = "action") -> DataFrame:
    """Feasible power and the action that really took place."""
    return df.withColumns(
        {
            "charge_mw": F.when(F.col(request) == "charge", feasible_charge()).otherwise(F.lit(0.0)),
            "discharge_mw": F.when(F.col(request) == "discharge", feasible_discharge()).otherwise(F.lit(0.0)),
        }
    ).withColumn(
        action,
        F.when(F.col("charge_mw") > NOISE_MW, "Charge")
        .when(F.col("discharge_mw") > NOISE_MW, "Discharge")
        .otherwise("Hold"),
    )


def power_from_soc(df: DataFrame) -> DataFrame:
    """Charge and discharge power implied by the change of stored energy."""
    step = F.col("soc_mwh") - F.col("soc_start_mwh")
    return df.withColumns(
        {
            "charge_mw": F.greatest(step, F.lit(0.0)) / (F.col("charge_efficiency") * F.col("interval_hours")),
            "discharge_mw": F.greatest(-step, F.lit(0.0)) * F.col("discharge_efficiency") / F.col("interval_hours"),
        }
    )


def realized_profit(df: DataFrame, price: str = "actual") -> DataFrame:
    """Costs and revenue of every interval against the actual price."""
    traded = (F.col("charge_mw") + F.col("discharge_mw")) * F.col("interval_hours")
    gross = (F.col("discharge_mw") - F.col("charge_mw")) * F.col("interval_hours") * F.col(price)
    return df.withColumns(
        {
            "gross_realized_revenue": gross,
            "degradation_cost": F.col("degradation_cost_per_mwh") * traded,
            "transaction_cost": F.col("transaction_cost_per_mwh") * traded,
        }
    ).withColumn(
        "realized_revenue",
        F.col("gross_realized_revenue") - F.col("degradation_cost") - F.col("transaction_cost"),
    )


def cumulative_profit(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    return running(df, keys, {"cumulative_profit": ("sum", "realized_revenue")}, pos)


def terminal_value(df: DataFrame, keys: list[str], pos: str = "pos", scale: float = 1_000.0) -> DataFrame:
    """Value of the energy left at the end of each episode, and its reward.

    The change of stored energy is priced at the trailing mean forecast of the
    last interval and added to the episode's realised profit.
    """
    last = F.max_by(
        F.struct("time_stamp", "soc_mwh", "initial_soc_mwh", "forecast_rolling_mean"), pos
    )
    ends = df.groupBy(*keys).agg(last.alias("_l"), F.sum("realized_revenue").alias("realized_profit"))
    adjusted = (F.col("_l.soc_mwh") - F.col("_l.initial_soc_mwh")) * F.col("_l.forecast_rolling_mean")
    return ends.select(
        *keys,
        F.col("_l.time_stamp").alias("time_stamp"),
        F.col("_l.soc_mwh").alias("soc_mwh"),
        "realized_profit",
        adjusted.alias("terminal_soc_adjustment"),
        ((F.col("realized_profit") + adjusted) / scale).alias("episode_reward"),
    )


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
