"""Registration of queries with their SQL twins, and rounding on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Sums of doubles depend on order, so computed doubles are compared rounded.
# Running totals grow large and keep fewer places; means of stored energy can
# end exactly on half of the sixth place and keep more.
DIGITS = 6
PLACES = {
    **dict.fromkeys(("cumulative_profit", "running_peak", "drawdown", "total_profit_usd", "total_profit"), 3),
    "average_soc_mwh": 9,
    **dict.fromkeys(
        (
            "median_soc_mwh", "average_soc_percentage", "equivalent_full_cycles",
            "average_cycles_per_day", "highest_value", "lowest_value", "average_value",
            *(f"h{h:02d}" for h in range(24)),
        ),
        8,
    ),
}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """Round the named columns, or every double column."""
    chosen = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, PLACES.get(c, digits)) for c in chosen})


def r(expression: str, name: str | None = None, digits: int = DIGITS) -> str:
    """The SQL side of ``rounded``; adding zero turns -0.0 into 0.0."""
    name = name or expression
    return f"round({expression}, {PLACES.get(name, digits)}) + 0.0 AS {name}"


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def as_int(c: Column) -> Column:
    return c.cast("int")
