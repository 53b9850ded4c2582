"""Threshold strategy and replay of a given action log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatt.operators.blocks import block_window, drop_copies, with_blocks
from tidewatt.operators.rolling import Trailing, add_trailing, drop_states, rolling_quantiles
from tidewatt.operators.settle import apply_request, cumulative_profit, realized_profit
from tidewatt.operators.soc import soc_path
from tidewatt.settings import BATTERY_COLUMNS, BLOCK_ROWS, Battery, Rules, with_scenarios


def threshold_signal(price: str = "predicted") -> Column:
    """Wish of the rule: nothing without thresholds, charging first on a tie."""
    p, low, high = F.col(price), F.col("lower_threshold"), F.col("upper_threshold")
    return (
        F.when(low.isNull() | high.isNull(), "hold")
        .when(p <= low, "charge")
        .when(p >= high, "discharge")
        .otherwise("hold")
    )


def with_thresholds(df: DataFrame, keys: list[str], rules: Rules = Rules(), size: int = BLOCK_ROWS) -> DataFrame:
    return rolling_quantiles(
        df,
        keys,
        "predicted",
        {"lower_threshold": rules.lower_quantile, "upper_threshold": rules.upper_quantile},
        rules.window,
        rules.minimum_history,
        size=size,
    )


#: Columns that settlement adds; all but the last come from the row alone.
SETTLED = ("gross_realized_revenue", "degradation_cost", "transaction_cost", "realized_revenue", "cumulative_profit")


def replay_requests(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Levels, feasible power, settlement and running profit of a request column.

    ``columns`` names what the caller reads besides levels, power and battery: other
    columns do not travel through the replay, which writes its rows, and settlement and
    running profit are left out where nobody asks for them.
    """
    asked = set(SETTLED if columns is None else columns)
    if columns is not None:
        carried = {*keys, *BATTERY_COLUMNS, "initial_level", "pos", "request", *columns}
        carried |= {"actual"} if asked & set(SETTLED) else set()
        df = df.select(*[c for c in df.columns if c in carried])
    rows = apply_request(soc_path(df, keys))
    if asked & set(SETTLED):
        rows = realized_profit(rows)
    return cumulative_profit(rows, keys) if "cumulative_profit" in asked else rows


def rules_backtest(
    predictions: DataFrame,
    keys: list[str],
    scenarios: list[Battery] | None = None,
    rules: Rules = Rules(),
    columns: list[str] | None = None,
) -> DataFrame:
    """Thresholds once per series, then one replay per series and scenario."""
    signals = with_thresholds(predictions, keys, rules).withColumn("request", threshold_signal())
    return replay_requests(with_scenarios(signals, scenarios or [Battery()]), [*keys, "scenario_id"], columns)


def action_log_backtest(
    log: DataFrame,
    keys: list[str],
    scenarios: list[Battery] | None = None,
    action: str = "action_code",
    columns: list[str] | None = None,
) -> DataFrame:
    """Settle logged actions (0 charge, 1 hold, 2 discharge); other codes are refused."""
    a = F.col(action)
    request = (
        F.when(a == 0, "charge")
        .when(a == 1, "hold")
        .when(a == 2, "discharge")
        .otherwise(F.raise_error(F.concat(F.lit("invalid action "), F.coalesce(a.cast("string"), F.lit("null")))))
    )
    return replay_requests(
        with_scenarios(log.withColumn("request", request), scenarios or [Battery()]), [*keys, "scenario_id"], columns
    )


MARKET = Trailing("market", "predicted", (96,), minimum=1)


def market_context(df: DataFrame, keys: list[str], size: int = BLOCK_ROWS) -> DataFrame:
    """Trailing day's forecast mean and volatility; the first rows use what exists."""
    rows = with_blocks(df, before=97, size=size)
    w = block_window(keys)
    rows = add_trailing(rows, w, [MARKET]).withColumn("_first", F.lag("predicted", 1).over(w).isNull())
    rows = rows.withColumns(
        {
            "forecast_rolling_mean": F.coalesce(MARKET.mean(96), F.when(F.col("_first"), F.col("predicted"))),
            "forecast_rolling_volatility": F.coalesce(MARKET.std(96), F.lit(0.0)),
        }
    )
    return drop_copies(drop_states(rows.drop("_first"), [MARKET]))
