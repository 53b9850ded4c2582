"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.operators.blocks import running
from tidewatt.operators.positions import number_rows
from tidewatt.session import attach, durable

# Distinct values of a group that one task ranks; larger groups are ranked in blocks.
FIT = 100_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row per key with linearly interpolated quantiles, nulls left out.

    Rows are first reduced to (value, count) pairs, so a value shared by a third of
    the table is one row.  The pairs of a key are ranked by one window where they
    fit a task, and otherwise by range-partitioned numbering and block-wise running
    counts; both are exact for any size.
    """
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, quantiles).drop("_all")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    pairs = durable(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    sizes = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"), F.sum("_c").alias("_n"))
    if (sizes.agg(F.max("_d")).first()[0] or 0) <= FIT:
        key = Window.partitionBy(*keys)
        ranked = pairs.withColumns({"_upto": F.sum("_c").over(key.orderBy("_v")), "_n": F.sum("_c").over(key)})
    else:
        numbered = number_rows(pairs, keys, ["_v"], "_i")
        ranked = attach(running(numbered, keys, {"_upto": ("sum", "_c")}, "_i"), sizes.drop("_d"), keys, "inner")
    start = F.col("_upto") - F.col("_c")

    def at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < F.col("_upto")), F.col("_v")))

    columns = []
    for name, p in quantiles.items():
        target = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = at(F.floor(target)), at(F.ceil(target))
        columns.append((low + (high - low) * F.max(target - F.floor(target))).alias(name))
    return ranked.groupBy(*keys).agg(*columns)
