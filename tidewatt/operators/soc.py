"""State of charge along a series of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatt.operators.scan import FAN, opening_states
from tidewatt.operators.settle import requested_energy
from tidewatt.session import durable, join_shuffled
from tidewatt.settings import BATTERY_COLUMNS


def soc_path(df: DataFrame, keys: list[str], request: str = "request", pos: str = "pos") -> DataFrame:
    """Add ``soc_start_mwh`` and ``soc_mwh`` by replaying clamped steps in order.

    One interval maps the stored energy x to clip(x + step, minimum, capacity).
    Such maps are closed under composition, so a block of intervals shrinks to
    one (step, low, high) triple and blocks are chained by their triples; the
    rows inside each block are then replayed from the block's opening level.
    """
    battery = [c for c in BATTERY_COLUMNS if c in df.columns and c not in keys]
    payload = [c for c in df.columns if c not in {*keys, *battery, "initial_level"}]
    steps = df.withColumn("_step", requested_energy(request)).withColumn("_block", F.floor(F.col(pos) / FAN))
    item = F.struct(F.col(pos).alias("_o"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(payload)], "_step")
    blocks = durable(steps.groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list(item)).alias("_rows"),
        # The battery is one per key; its constants stay out of the rows.
        F.first(F.struct(*battery)).alias("_battery"),
    ))
    low, high = F.col("_battery.minimum_soc_mwh"), F.col("_battery.capacity_mwh")
    moves = F.transform("_rows", lambda r: F.struct(r["_step"].alias("a"), low.alias("lo"), high.alias("hi")))
    initial = F.col("_battery.initial_soc_mwh").alias("_initial")
    maps = blocks.select(*keys, "_block", initial, compose_clamps(moves).alias("_map"))
    opened = join_shuffled(blocks, opening_states(maps, keys, compose_clamps, walk_clamps, "_initial"), [*keys, "_block"])
    path = walk_clamps(
        F.concat(moves, F.array(F.struct(F.lit(0.0).alias("a"), low.alias("lo"), high.alias("hi")))),
        F.col("_opening"),
    )
    return (
        opened.withColumn("_path", path)
        .select(*keys, "_path", "_battery", F.posexplode("_rows").alias("_i", "_r"))
        .select(
            *keys,
            *[F.col(f"_r._c{i}").alias(c) for i, c in enumerate(payload)],
            *[F.col("_battery")[c].alias(c) for c in battery],
            F.col("_path")[F.col("_i")].alias("soc_start_mwh"),
            F.col("_path")[F.col("_i") + 1].alias("soc_mwh"),
        )
    )


def compose_clamps(maps: Column) -> Column:
    """One clamp equal to applying an ordered array of clamps."""
    inf = float("inf")
    neutral = F.struct(F.lit(0.0).alias("a"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"))

    def then(done, nxt):
        return F.struct(
            (done["a"] + nxt["a"]).alias("a"),
            _clip(done["lo"] + nxt["a"], nxt).alias("lo"),
            _clip(done["hi"] + nxt["a"], nxt).alias("hi"),
        )

    return F.aggregate(maps, neutral, then)


def walk_clamps(maps: Column, opening: Column) -> Column:
    """State before each clamp of an ordered array."""
    path = F.aggregate(
        maps,
        F.array(opening.cast("double")),
        lambda done, m: F.array_append(done, _clip(F.element_at(done, -1) + m["a"], m)),
    )
    return F.slice(path, F.lit(1), F.size(maps))


def _clip(x: Column, m: Column) -> Column:
    return F.greatest(m["lo"], F.least(m["hi"], x))
