"""Carry a state through a long series of maps, level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidewatt.session import durable, join_shuffled

# Maps folded by one row of one task.
FAN = 96


def opening_states(
    maps: DataFrame,
    keys: list[str],
    compose: Callable[[Column], Column],
    walk: Callable[[Column, Column], Column],
    start: str,
    block: str = "_block",
    fan: int = FAN,
) -> DataFrame:
    """State at the opening of every block.

    ``maps`` has one row per (keys, block) with a ``_map`` and the series'
    ``start`` state.  ``compose`` turns an ordered array of maps into one map;
    ``walk`` takes that array and an opening state and returns the state before
    each map.  Blocks are folded ``fan`` at a time and the levels above work on
    ever fewer rows, so the longest list in any task has ``fan`` entries.
    """
    low, high = maps.agg(F.min(block), F.max(block)).first()
    if low is None:
        return maps.select(*keys, block, F.col(start).alias("_opening"))
    return _descend(maps, keys, compose, walk, start, block, fan, low, high)


def _descend(maps, keys, compose, walk, start, block, fan, low, high):
    parent = "_up" + block
    lists = (
        maps.withColumn(parent, F.floor((F.col(block) - low) / fan))
        .groupBy(*keys, parent)
        .agg(
            F.sort_array(F.collect_list(F.struct(F.col(block).alias("b"), F.col("_map").alias("m")))).alias("_list"),
            F.first(start).alias(start),
        )
    )
    ms = F.transform("_list", lambda x: x["m"])
    if high - low < fan:
        opened = lists.withColumn("_from", F.col(start))
    else:
        lists = durable(lists.withColumn("_map", compose(ms)))
        above = _descend(lists, keys, compose, walk, start, parent, fan, 0, (high - low) // fan)
        opened = join_shuffled(lists, above.withColumnRenamed("_opening", "_from"), [*keys, parent])
    path = F.arrays_zip(F.transform("_list", lambda x: x["b"]).alias("b"), walk(ms, F.col("_from")).alias("s"))
    return opened.select(*keys, F.explode(path).alias("_p")).select(
        *keys, F.col("_p.b").alias(block), F.col("_p.s").alias("_opening")
    )
