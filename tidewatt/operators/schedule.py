"""Best charge and discharge schedules: whole days and rolling look-ahead."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidewatt.operators import energy_value as ev
from tidewatt.operators.blocks import BLOCK, COPY, with_blocks
from tidewatt.operators.scan import opening_states
from tidewatt.operators.settle import cumulative_profit, power_from_soc, realized_profit
from tidewatt.session import durable, join_shuffled
from tidewatt.settings import BATTERY_COLUMNS

# Rows planned by one call of the rolling kernel.
CHUNK = 512


def daily_schedule(
    df: DataFrame, keys: list[str], price: str = "predicted", enforce_terminal: bool = True
) -> DataFrame:
    """Profit-maximal schedule of every calendar day.

    Each day starts at the initial level and, with ``enforce_terminal``, ends
    there, so days are independent jobs.  ``df`` has one row per (key,
    timestamp) and battery columns; adds ``soc_start_mwh``, ``soc_mwh`` and power.
    """
    payload = [c for c in df.columns if c not in {*keys, *BATTERY_COLUMNS, "initial_level"}]
    item = F.struct(F.col("time_stamp").alias("_o"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(payload)])
    days = df.groupBy(*keys, F.to_date("time_stamp").alias("_day")).agg(
        F.sort_array(F.collect_list(item)).alias("_rows"), _battery_of_group()
    )
    at = payload.index(price)

    @F.pandas_udf(ArrayType(DoubleType()))
    def plan(prices: pd.Series, battery: pd.DataFrame) -> pd.Series:
        return pd.Series(ev.each_battery(prices, battery, lambda p, b: ev.day_paths(p, b, enforce_terminal)))

    path = plan(F.transform("_rows", lambda r: r[f"_c{at}"].cast("double")), F.col("_battery"))
    opened = days.withColumn("_path", path).select(*keys, "_path", "_battery", F.posexplode("_rows").alias("_i", "_r"))
    return power_from_soc(_unpack(opened, keys, payload))


def rolling_schedule(df: DataFrame, keys: list[str], price: str = "predicted", horizon: int = 16) -> DataFrame:
    """Re-plan at every interval over ``horizon`` rows, commit only the first.

    The best first move from every possible level depends on prices alone, so
    it is worked out for all intervals in parallel.  Each chunk of intervals
    then becomes one map from opening to closing level; the maps are chained
    to give every chunk its opening level, and the chunks replay their moves.
    ``df`` has ``pos`` and battery columns; series longer than one chunk split.
    """
    payload = [c for c in df.columns if c not in {*keys, *BATTERY_COLUMNS, "initial_level"}]
    at = payload.index(price)
    item = F.struct(F.col("pos").alias("_o"), F.col(COPY).alias("_copy"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(payload)])
    chunks = (
        with_blocks(df, after=horizon - 1, size=CHUNK)
        .groupBy(*keys, BLOCK)
        .agg(
            F.sort_array(F.collect_list(item)).alias("_all"), _battery_of_group(), F.first("initial_level").alias("_start")
        )
        .withColumn("_rows", F.filter("_all", lambda r: ~r["_copy"]))
        .filter(F.size("_rows") > 0)
    )
    prices = F.transform("_all", lambda r: r[f"_c{at}"].cast("double"))

    @F.pandas_udf(_MOVES)
    def moves(prices: pd.Series, committed: pd.Series, battery: pd.DataFrame) -> pd.DataFrame:
        parts = pd.DataFrame({"p": prices, "n": committed})
        done = ev.each_battery(parts, battery, lambda p, b: ev.chunk_moves(p["p"], p["n"], b, horizon))
        return pd.DataFrame(done, columns=[f.name for f in _MOVES.fields])

    planned = durable(
        chunks.withColumn("_m", moves(prices, F.size("_rows"), F.col("_battery")))
        .withColumn("_prices", prices)
        .drop("_all")
    )
    maps = planned.select(*keys, BLOCK, F.struct(F.col("_m.x").alias("x"), F.col("_m.y").alias("y")).alias("_map"), "_start")
    opened = join_shuffled(planned, opening_states(maps, keys, _compose, _walk, "_start"), [*keys, BLOCK])

    @F.pandas_udf(ArrayType(DoubleType()))
    def replay(m: pd.DataFrame, prices: pd.Series, opening: pd.Series, battery: pd.DataFrame) -> pd.Series:
        parts = pd.DataFrame({"up": m["up"], "down": m["down"], "p": prices, "s": opening})
        return pd.Series(ev.each_battery(parts, battery, lambda p, b: ev.replay(p, b, horizon)))

    pathed = opened.withColumn("_path", replay("_m", "_prices", "_opening", "_battery"))
    exploded = pathed.select(*keys, "_path", "_battery", F.posexplode("_rows").alias("_i", "_r"))
    return power_from_soc(_unpack(exploded, keys, payload))


def settle_schedule(schedule: DataFrame, keys: list[str], price: str = "actual", cumulative: bool = True) -> DataFrame:
    """Profit and, unless switched off, running profit, which writes the schedule so that its kernel runs once."""
    settled = realized_profit(schedule, price)
    return cumulative_profit(settled, keys) if cumulative else settled


def perfect_foresight(df: DataFrame, keys: list[str]) -> DataFrame:
    """The daily schedule planned on the prices that later came true."""
    return daily_schedule(df.withColumn("predicted", F.col("actual")), keys)


_MOVES = StructType([StructField(n, ArrayType(LongType())) for n in ("up", "down", "x", "y")])


def _compose(maps: Column) -> Column:
    @F.pandas_udf("struct<x:array<bigint>,y:array<bigint>>")
    def composed(lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ev.compose(m) for m in lists], columns=["x", "y"])

    return composed(maps)


def _walk(maps: Column, opening: Column) -> Column:
    @F.pandas_udf(ArrayType(LongType()))
    def walked(lists: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ms, starts in lists:
            yield pd.Series([ev.walk(m, s) for m, s in zip(ms, starts)])

    return walked(maps, opening)


def _battery_of_group() -> Column:
    return F.first(F.struct(*BATTERY_COLUMNS)).alias("_battery")


def _unpack(exploded: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    return exploded.select(
        *keys,
        *[F.col(f"_r._c{i}").alias(c) for i, c in enumerate(payload)],
        *[F.col("_battery")[c].alias(c) for c in BATTERY_COLUMNS if c not in keys],
        F.col("_path")[F.col("_i")].alias("soc_start_mwh"),
        F.col("_path")[F.col("_i") + 1].alias("soc_mwh"),
    )
