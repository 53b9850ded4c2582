"""Put irregular readings on a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.operators.positions import slot_position, slot_time
from tidewatt.session import durable
from tidewatt.settings import BLOCK_ROWS, SLOT_SECONDS


def collapse_duplicates(df: DataFrame, keys: list[str], measures: list[str], ts: str = "time_stamp") -> DataFrame:
    """One row per (key, timestamp): the mean of every measure."""
    return df.groupBy(*keys, ts).agg(*[F.avg(m).alias(m) for m in measures])


def floor_slot(ts: Column | str, seconds: int = SLOT_SECONDS) -> Column:
    """Start of the slot that holds ``ts``."""
    return slot_time(slot_position(ts, seconds), seconds)


def shift_time(df: DataFrame, minutes: int, ts: str = "time_stamp") -> DataFrame:
    return df.withColumn(ts, F.col(ts) - F.expr(f"INTERVAL '{minutes}' MINUTE"))


def fill_forward(
    df: DataFrame,
    keys: list[str],
    ts: str = "time_stamp",
    seconds: int = SLOT_SECONDS,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Complete grid from first to last timestamp, last value carried forward.

    ``df`` holds one row per (key, timestamp).  Every row fills the slots up to
    its successor.  Successors are found inside time blocks; the last row of a
    block takes the first timestamp of the next block that has any rows.  A gap is
    first cut into one piece for each block that it crosses and the pieces are dealt
    out, so that a single stray timestamp, decades off, is filled by all tasks.
    """
    slot = slot_position(ts, seconds)
    aligned = slot_time(slot, seconds) == F.col(ts)
    # First grid point at or after the row; the last row fills it only if it is there.
    rows = df.withColumn("_slot", slot).withColumn("_start", F.when(aligned, F.col("_slot")).otherwise(F.col("_slot") + 1))
    # Written once: block edges and rows both read it, and what made it runs one time.
    rows = durable(rows.withColumn("_block", F.floor(F.col("_slot") / size)))
    edges = rows.groupBy(*keys, "_block").agg(F.min("_start").alias("_first"))
    following = edges.select(
        *keys, "_block", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block")).alias("_after")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(ts)
    linked = rows.withColumn("_next", F.lead("_start").over(inside)).join(following, [*keys, "_block"], "left")
    # A row owns the points before its successor's first; the last row owns its own slot.
    stop = F.coalesce(F.col("_next") - 1, F.col("_after") - 1, F.col("_slot"))
    owned = linked.withColumn("_stop", stop).filter("_start <= _stop")
    crossed = F.sequence(F.floor(F.col("_start") / size), F.floor(F.col("_stop") / size))
    pieces = owned.withColumn("_block", F.explode(crossed)).withColumns(
        {
            "_start": F.greatest("_start", F.col("_block") * size),
            "_stop": F.least("_stop", (F.col("_block") + 1) * size - 1),
        }
    )
    return (
        pieces.repartition(*keys, "_block")
        .withColumn("_slot", F.explode(F.sequence("_start", "_stop")))
        .withColumn(ts, slot_time(F.col("_slot"), seconds))
        .drop("_block", "_next", "_after", "_start", "_stop", "_slot")
    )
