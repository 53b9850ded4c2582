"""Row positions inside each series, computed without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.session import attach, durable
from tidewatt.settings import SLOT_SECONDS


def slot_position(ts: Column | str, seconds: int = SLOT_SECONDS) -> Column:
    """Position on a complete, duplicate-free grid: the absolute slot number.

    Consecutive rows differ by exactly one, which is all that lags and frames
    need, and it takes neither a sort nor a shuffle.  ``seconds`` divides a day.
    """
    instant = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(F.to_date(instant), F.lit("1970-01-01").cast("date")).cast("bigint")
    inside = F.hour(instant) * 3600 + F.minute(instant) * 60 + F.floor(F.second(instant))
    return days * (86_400 // seconds) + F.floor(inside / seconds)


def slot_time(slot: Column, seconds: int = SLOT_SECONDS) -> Column:
    """Start time of an absolute slot number."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.expr(f"INTERVAL '{seconds}' SECOND") * slot


def number_rows(
    df: DataFrame, keys: list[str], order: list[Column | str], name: str = "pos", copies: bool = False
) -> DataFrame:
    """Zero-based row number per ``keys`` in ``order``, for any distribution.

    Rows are range-partitioned on (keys, order), so one key may hold most of
    the table and still spread over all partitions.  Each partition is sorted
    and numbered locally; a small table of (key, partition) row counts then
    supplies the starting number.  Rows equal in every sort column stay in one
    range; with ``copies`` they are spread too, by a random last sort key that
    is written down first, so that a repeated task sees the same values.
    """
    sort, parts = [*keys, *order], []
    if copies:
        df = durable(df.withColumn("_tie", F.rand(42)))
        sort.append("_tie")
        # A stated number keeps spread rows apart; otherwise adaptive execution sizes the ranges.
        parts = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))]
    local = durable(
        df.repartitionByRange(*parts, *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        local.groupBy(*keys, "_part")
        .agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    return (
        attach(local, starts, [*keys, "_part"])
        .withColumn(name, F.col("_seq") - F.col("_first") + F.col("_start"))
        .drop("_part", "_seq", "_first", "_start", "_tie")
    )
