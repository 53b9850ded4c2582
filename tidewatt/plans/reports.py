"""Tables behind each report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.functions.scalars import (
    ACTIONS,
    STATES,
    action_from_text,
    clip,
    finite,
    lenient_double,
    net_dispatch,
    operating_state,
)
from tidewatt.operators.interpolate import interpolate_rows
from tidewatt.operators.metrics import error_metrics
from tidewatt.operators.positions import number_rows
from tidewatt.operators.quantiles import exact_quantiles
from tidewatt.session import attach, durable

# Fields that strategy and horizon reports compare.
COMPARED = {
    "total_profit": "total_profit_usd",
    "sharpe_ratio": "annualized_daily_sharpe",
    "maximum_drawdown": "maximum_drawdown_usd",
    "profit_factor": "profit_factor",
    "equivalent_full_cycles": "equivalent_full_cycles",
}


# --- forecasts ---------------------------------------------------------------


def in_range(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "time_stamp") -> DataFrame:
    """Rows from ``start`` to ``end`` inclusive; a plain date means its midnight."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return df


def slice_report(df: DataFrame, keys: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Errors of a time slice with its span and its highest price event."""
    rows = in_range(df, start, end)
    peak = rows.groupBy(*keys).agg(
        F.min("time_stamp").alias("first_time"),
        F.max("time_stamp").alias("last_time"),
        first_extreme(F.col("actual"), F.struct("time_stamp", "actual", "predicted")).alias("_p"),
    )
    return error_metrics(rows, keys).join(
        peak.select(
            *keys,
            "first_time",
            "last_time",
            F.col("_p.time_stamp").alias("peak_time"),
            F.col("_p.actual").alias("peak_price"),
            F.col("_p.predicted").alias("peak_forecast"),
            F.abs(F.col("_p.actual") - F.col("_p.predicted")).alias("peak_absolute_error"),
        ),
        keys,
    )


def first_extreme(value: Column, row: Column, ts: str = "time_stamp", largest: bool = True) -> Column:
    """Row of the largest or smallest value; the earliest row wins a tie.

    An aggregate with map-side combine, where a ranking window would sort.
    """
    early = F.lit("1970-01-01").cast("timestamp_ntz") - F.col(ts)
    order = F.struct(value if largest else -value, early)
    return F.max_by(row, F.when(value.isNotNull(), order))


def improvement(metrics: DataFrame, baseline: str = "Linear Regression") -> DataFrame:
    """RMSE gain of each model over the baseline model, in percent."""
    base = F.max(F.when(F.col("model") == baseline, F.col("rmse")))
    reference = metrics.agg(base.alias("_base"))
    # Both sides are the handful of rows of a comparison table.
    return metrics.withColumn("_k", F.lit(1)).join(F.broadcast(reference.withColumn("_k", F.lit(1))), "_k").select(
        *metrics.columns, ((F.col("_base") - F.col("rmse")) / F.col("_base") * 100).alias("improvement")
    )


def quantile_band(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies between two quantiles of its group, ends included."""
    bounds = exact_quantiles(df, keys, value, {"band_low": low, "band_high": high})
    if keys:
        rows = attach(df, bounds, keys, "inner")
    else:
        rows = attach(df.withColumn("_all", F.lit(1)), bounds.withColumn("_all", F.lit(1)), ["_all"], "inner").drop("_all")
    return rows.filter(F.col(value).between(F.col("band_low"), F.col("band_high")))


def residual_histogram(df: DataFrame, keys: list[str], bins: int = 120) -> DataFrame:
    """Counts of the central 99 percent of errors in equal bins per key."""
    band = quantile_band(df, keys, "error", 0.005, 0.995)
    lo, hi, e = F.col("band_low"), F.col("band_high"), F.col("error")
    number = F.when(hi > lo, F.least(F.floor((e - lo) / F.when(hi > lo, hi - lo) * bins), F.lit(bins - 1))).otherwise(0)
    width = (hi - lo) / bins
    return (
        band.groupBy(*keys, number.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("observations"), F.first(lo).alias("_lo"), F.first(width).alias("_w"))
        .select(*keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"), "observations")
    )


# --- rankings ----------------------------------------------------------------


def top_shares(df: DataFrame, value: str, label: str, n: int) -> DataFrame:
    """The ``n`` largest rows, smallest first, and their share of the shown total."""
    top = df.orderBy(F.desc(value), label).limit(n)
    # At most n rows are left, so an unpartitioned window is safe.
    everything = Window.partitionBy()
    return top.withColumn("share", F.col(value) / F.sum(value).over(everything) * 100).orderBy(value, F.desc(label))


def seeded_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of ``n`` rows: the smallest seeded hashes of the key."""
    return df.orderBy(F.md5(F.concat_ws("-", F.lit(seed), *key)), *key).limit(n)


def scale_robust(
    df: DataFrame, keys: list[str], value: str, name: str = "scaled", fitted_on: DataFrame | None = None
) -> DataFrame:
    """Clip to the 5th and 95th percentile and scale to 0..1; flat or missing gives 0.5.

    Percentiles use finite values only; positive infinity maps to 1, negative to 0.
    They come from ``fitted_on`` (default: ``df`` itself), so that bounds learnt on
    one period can be applied to another.
    """
    rows = df.withColumn("_v", F.col(value).cast("double")).withColumn("_f", finite("_v"))
    seen = rows if fitted_on is None else fitted_on.withColumn("_f", finite(F.col(value).cast("double")))
    bounds = exact_quantiles(seen, keys, "_f", {"_lo": 0.05, "_hi": 0.95})
    if keys:
        rows = attach(rows, bounds, keys)
    else:
        rows = attach(rows.withColumn("_all", F.lit(1)), bounds.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
    lo, hi = F.col("_lo"), F.col("_hi")
    close = F.abs(lo - hi) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(hi)
    scaled = (clip("_v", lo, hi) - lo) / F.when(~close, hi - lo)
    return rows.withColumn(
        name,
        F.when(lo.isNull() | close | F.col("_v").isNull() | F.isnan("_v"), F.lit(0.5)).otherwise(scaled),
    ).drop("_v", "_f", "_lo", "_hi")


# --- dispatch ----------------------------------------------------------------


def best_day(df: DataFrame, keys: list[str], date: str | None = None) -> DataFrame:
    """Intervals of one date: the given one or each key's most profitable."""
    day = F.to_date("time_stamp")
    if date is not None:
        return df.filter(day == F.lit(date).cast("date"))
    profits = df.groupBy(*keys, day.alias("_d")).agg(F.sum("realized_revenue").alias("_p"))
    chosen = profits.groupBy(*keys).agg(F.max_by("_d", F.struct("_p", -F.unix_date("_d"))).alias("selected_date"))
    return attach(df, chosen, keys, "inner").filter(day == F.col("selected_date"))


def extreme_days(days: DataFrame, keys: list[str]) -> DataFrame:
    """Best and worst day per key; the earlier day wins a tie."""
    early = -F.unix_date("date")
    return days.groupBy(*keys).agg(
        F.max_by("date", F.struct("daily_profit", early)).alias("best_date"),
        F.max("daily_profit").alias("best_profit"),
        F.max_by("date", F.struct(-F.col("daily_profit"), early)).alias("worst_date"),
        F.min("daily_profit").alias("worst_profit"),
        F.sum("daily_profit").alias("total_profit"),
    )


def action_counts(df: DataFrame, keys: list[str], action: str = "action") -> DataFrame:
    return df.groupBy(*keys, action).agg(F.count(F.lit(1)).alias("intervals"))


def action_price_summary(df: DataFrame, keys: list[str], price: str, action: str) -> DataFrame:
    """Price statistics per action with each action's share of intervals."""
    rows = clean_actions(df, keys, price, action)
    stats = rows.groupBy(*keys, "action").agg(
        F.count(F.lit(1)).alias("intervals"),
        F.avg("price").alias("mean_price"),
        F.stddev_samp("price").alias("price_std"),
        F.min("price").alias("minimum_price"),
        F.max("price").alias("maximum_price"),
    )
    medians = exact_quantiles(rows, [*keys, "action"], "price", {"median_price": 0.5})
    # Three actions per key at most.
    share = F.col("intervals") / F.sum("intervals").over(Window.partitionBy(*keys)) * 100
    return stats.join(medians, [*keys, "action"]).withColumn("action_percentage", share)


def clean_actions(df: DataFrame, keys: list[str], price: str, action: str) -> DataFrame:
    return df.select(
        *keys, lenient_double(price).alias("price"), action_from_text(action).alias("action")
    ).na.drop(subset=["price", "action"])


def median_spread(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Median price when discharging less median price when charging."""
    of = {a: F.max(F.when(F.col("action") == a, F.col("median_price"))) for a in ACTIONS}
    return stats.groupBy(*keys).agg(
        of["Charge"].alias("charge_median"),
        of["Hold"].alias("hold_median"),
        of["Discharge"].alias("discharge_median"),
        (of["Discharge"] - of["Charge"]).alias("median_spread"),
    )


def month_hour_profile(
    df: DataFrame, keys: list[str], value: str = "soc_mwh", capacity: str = "capacity_mwh", ts: str = "time_stamp"
) -> DataFrame:
    """Level statistics per month and hour of day, and the mean share of each row's own capacity."""
    rows = df.select(
        *keys,
        F.month(ts).alias("month_number"),
        F.date_format(ts, "MMM").alias("month_label"),
        F.hour(ts).alias("hour"),
        F.col(value).cast("double").alias("_v"),
        F.col(capacity).cast("double").alias("_cap"),
    ).na.drop(subset=["month_number", "_v"])
    by = [*keys, "month_number", "month_label", "hour"]
    stats = rows.groupBy(*by).agg(
        F.avg("_v").alias("average_soc_mwh"),
        F.min("_v").alias("minimum_soc_mwh"),
        F.max("_v").alias("maximum_soc_mwh"),
        F.count(F.lit(1)).alias("observations"),
        F.avg(F.col("_v") / F.col("_cap") * 100).alias("average_soc_percentage"),
    )
    medians = exact_quantiles(rows, by, "_v", {"median_soc_mwh": 0.5})
    return stats.join(medians, by)


def month_hour_grid(profile: DataFrame, keys: list[str], value: str = "average_soc_mwh") -> DataFrame:
    """One row per month with 24 hour columns of ``value`` (mean, share or count); hours without data stay null."""
    return profile.groupBy(*keys, "month_number", "month_label").agg(
        *[F.max(F.when(F.col("hour") == h, F.col(value))).alias(f"h{h:02d}") for h in range(24)]
    )


def hourly_extremes(df: DataFrame, keys: list[str], value: str = "soc_mwh", ts: str = "time_stamp") -> DataFrame:
    """Hours with the highest and lowest mean, and the overall mean, low and high."""
    hours = df.groupBy(*keys, F.hour(ts).alias("hour")).agg(
        F.avg(value).alias("_m"),
        F.sum(value).alias("_s"),
        F.count(value).alias("_n"),
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
    )
    return hours.groupBy(*keys).agg(
        F.max_by("hour", F.struct("_m", -F.col("hour"))).alias("highest_hour"),
        F.max("_m").alias("highest_value"),
        F.max_by("hour", F.struct(-F.col("_m"), -F.col("hour"))).alias("lowest_hour"),
        F.min("_m").alias("lowest_value"),
        (F.sum("_s") / F.sum("_n")).alias("average_value"),
        F.min("_lo").alias("minimum_value"),
        F.max("_hi").alias("maximum_value"),
    )


def finite_dispatch(df: DataFrame, net: str | None = None) -> DataFrame:
    """Net dispatch and operating state of every row with a finite value."""
    rows = df.withColumn("net_dispatch_mw", finite(net_dispatch(net).cast("double"))).na.drop(subset=["net_dispatch_mw"])
    return rows.withColumn("operating_state", operating_state("net_dispatch_mw"))


def duration_curve(df: DataFrame, keys: list[str], net: str | None = None, ts: str = "time_stamp") -> DataFrame:
    """Rows from highest to lowest dispatch with their percentile position.

    Equal values get distinct positions, earlier rows first.
    """
    ranked = number_rows(finite_dispatch(df, net), keys, [F.col("net_dispatch_mw").desc(), F.col(ts)], "_i")
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    percentile = F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(
        F.col("_i") / F.when(F.col("_n") > 1, F.col("_n") - 1) * 100
    )
    return attach(ranked, sizes, keys).withColumn("duration_percentile", percentile).drop("_i", "_n")


def state_shares(df: DataFrame, keys: list[str], net: str | None = None) -> DataFrame:
    """Share of every operating state, zero when it never occurs."""
    counted = finite_dispatch(df, net).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("operating_state") == s).alias(s) for s in STATES],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("c")) for s in STATES]))
    return counted.select(*keys, "_n", rows.alias("_r")).select(
        *keys, F.col("_r.state").alias("operating_state"), (F.col("_r.c") / F.col("_n") * 100).alias("share_percent")
    )


def duration_statistics(df: DataFrame, keys: list[str], net: str | None = None) -> DataFrame:
    n = F.col("net_dispatch_mw")
    return finite_dispatch(df, net).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observation_count"),
        *[
            (F.avg((F.col("operating_state") == s).cast("double")) * 100).alias(f"{s.lower()}_share_percent")
            for s in STATES
        ],
        F.max(n).alias("peak_discharge_mw"),
        F.min(n).alias("peak_charge_mw"),
        F.avg(F.abs(n)).alias("mean_absolute_dispatch_mw"),
    )


# --- comparisons ---------------------------------------------------------------


def strategy_table(summaries: DataFrame, keys: list[str], strategy: str = "strategy") -> DataFrame:
    return summaries.select(
        *keys,
        strategy,
        *[(F.abs(c) if n == "maximum_drawdown" else F.col(c)).alias(n) for n, c in COMPARED.items()],
    )


def strategy_winners(table: DataFrame, keys: list[str], order: list[str], strategy: str = "strategy") -> DataFrame:
    """Most profit, best risk ratio and smallest drawdown; list order breaks ties."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(strategy))

    def winner(c: Column) -> Column:
        return F.max_by(strategy, F.when(c.isNotNull(), F.struct(c, -rank)))

    return table.groupBy(*keys).agg(
        winner(F.col("total_profit")).alias("best_profit_strategy"),
        F.max("total_profit").alias("best_profit"),
        winner(F.col("sharpe_ratio")).alias("best_sharpe_strategy"),
        F.max("sharpe_ratio").alias("best_sharpe"),
        winner(-F.col("maximum_drawdown")).alias("lowest_drawdown_strategy"),
        F.min("maximum_drawdown").alias("lowest_drawdown"),
    )


def capture_ladder(table: DataFrame, keys: list[str], ceiling: str, strategy: str = "strategy") -> DataFrame:
    """Profit of each strategy as a share of the ceiling strategy's, and the gap."""
    top = F.max(F.when(F.col(strategy) == ceiling, F.col("total_profit"))).over(Window.partitionBy(*keys))
    # One row per strategy and key.
    return table.select(
        *keys,
        strategy,
        "total_profit",
        (F.col("total_profit") / F.when(top != 0, top) * 100).alias("percent_of_ceiling"),
        (top - F.col("total_profit")).alias("gap_to_ceiling"),
    )


def keep_last(df: DataFrame, keys: list[str], ts: str, tiebreak: str) -> DataFrame:
    """The last row per timestamp; an aggregate, so copies combine before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, ts)]
    kept = df.groupBy(*keys, ts).agg(F.max_by(F.struct(*rest), F.col(tiebreak)).alias("_r"))
    return kept.select(*keys, ts, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def align_profits(frames: dict[str, DataFrame], keys: list[str], value: str = "cumulative_profit") -> DataFrame:
    """Running profit of every strategy on the union of their timestamps.

    Any number of strategies merge in one exchange: rows are tagged, put together and
    folded to one row per timestamp (of a repeated timestamp the highest value counts).
    Gaps are filled linearly by row position and flat at the ends.
    """
    tagged = [
        frame.select(*keys, "time_stamp", F.lit(name).alias("_of"), F.col(value).cast("double").alias("_v")).na.drop(subset=["_v"])
        for name, frame in frames.items()
    ]
    folded = reduce(DataFrame.unionByName, tagged).groupBy(*keys, "time_stamp").agg(
        *[F.max(F.when(F.col("_of") == name, F.col("_v"))).alias(name) for name in frames]
    )
    return interpolate_rows(number_rows(folded, keys, ["time_stamp"]), keys, list(frames))


def profit_endpoints(aligned: DataFrame, keys: list[str], strategies: list[str]) -> DataFrame:
    """Last and highest value per strategy, with the period's length in days."""
    long = aligned.select(
        *keys,
        "time_stamp",
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("value")) for s in strategies])
        ).alias("_s"),
    ).select(*keys, "time_stamp", "_s.*")
    days = F.extract(F.lit("DAY"), F.max("time_stamp") - F.min("time_stamp")).cast("bigint")
    return long.groupBy(*keys, "strategy").agg(
        F.max_by("value", "time_stamp").alias("final_value"),
        F.max("value").alias("peak_value"),
        first_extreme(F.col("value"), F.col("time_stamp")).alias("peak_time"),
        F.min("value").alias("lowest_value"),
        F.greatest(days, F.lit(1).cast("bigint")).alias("period_days"),
    )


# --- data quality ---------------------------------------------------------------


def duplicate_report(df: DataFrame, keys: list[str], value: str, ts: str = "time_stamp") -> DataFrame:
    """Timestamps that occur more than once, with statistics of their values."""
    return (
        df.groupBy(*keys, ts)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )
        .filter("rows > 1")
    )


def duplicate_share(df: DataFrame, keys: list[str], ts: str = "time_stamp") -> DataFrame:
    """Repeated timestamps and extra rows as part of all rows, per key."""
    per = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_c"))
    return per.groupBy(*keys).agg(
        F.sum("_c").alias("rows"),
        F.count_if(F.col("_c") > 1).alias("repeated_timestamps"),
        F.sum(F.col("_c") - 1).alias("extra_rows"),
        (F.count_if(F.col("_c") > 1) / F.sum("_c") * 100).alias("repeated_percentage"),
    )


def table_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, nulls, mean, deviation, quartiles and range of numeric columns."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
        ).alias("_r")
    ).select("_r.*")
    stats = long.groupBy("column").agg(
        F.count("v").alias("count"),
        F.count_if(F.col("v").isNull()).alias("nulls"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    quartiles = exact_quantiles(long, ["column"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return stats.join(quartiles, "column", "left")


def column_overview(df: DataFrame) -> DataFrame:
    """Rows, nulls, distinct values and range (as text) of every column, in one pass per column kind."""
    whole = df.agg(*[
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            F.count_distinct(F.col(c)).alias("distinct"),
            F.min(F.col(c)).cast("string").alias("first"),
            F.max(F.col(c)).cast("string").alias("last"),
        ).alias(c)
        for c in df.columns
    ])
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("of")) for c in df.columns])
    return whole.select(F.explode(named).alias("_r")).select("_r.column", "_r.of.*")


def earliest_slots(profile: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of a month-by-hour profile, in order of month and hour."""
    return profile.orderBy("month_number", "hour", *keys).limit(n)


def environment_scaling(df: DataFrame, keys: list[str], battery_columns: bool = True) -> DataFrame:
    """Forecast context on a common scale: z-scores, scaled volatility and level.

    A deviation or volatility scale that is tiny or missing counts as one.
    ``df`` has the market context columns and, for the level, battery columns.
    """
    base = durable(df)
    stats = base.groupBy(*keys).agg(F.avg("predicted").alias("_mean"), F.stddev_samp("predicted").alias("_std"))
    vol = exact_quantiles(base, keys, "forecast_rolling_volatility", {"_vol": 0.95})
    rows = attach(base, stats.join(vol, keys), keys)

    def safe(c: str) -> Column:
        return F.when(F.col(c) >= 1e-8, F.col(c)).otherwise(F.lit(1.0))

    scaled = {
        "forecast_scaled": (F.col("predicted") - F.col("_mean")) / safe("_std"),
        "mean_scaled": (F.col("forecast_rolling_mean") - F.col("_mean")) / safe("_std"),
        "volatility_scaled": F.col("forecast_rolling_volatility") / safe("_vol"),
    }
    if battery_columns:
        scaled["level_scaled"] = (F.col("soc_start_mwh") - F.col("minimum_soc_mwh")) / (
            F.col("capacity_mwh") - F.col("minimum_soc_mwh")
        )
    return rows.withColumns({n: clip(c, -10.0, 10.0) for n, c in scaled.items()}).drop("_mean", "_std", "_vol")
