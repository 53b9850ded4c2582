"""Large tables neither pass the driver nor take time that grows with the square of a block."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatt import session
from tidewatt.operators.interpolate import interpolate_rows
from tidewatt.operators.schedule import rolling_schedule
from tidewatt.operators.soc import soc_path
from tidewatt.settings import Battery, with_scenarios


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def requests(spark, n):
    wish = F.element_at(F.array(F.lit("charge"), F.lit("hold"), F.lit("discharge")), (F.col("pos") % 3 + 1).cast("int"))
    rows = spark.range(n).select(F.lit("a").alias("series_id"), F.col("id").alias("pos"), wish.alias("request"))
    return with_scenarios(rows, [Battery()])


def test_levels_of_blocks_are_joined_without_a_broadcast(spark):
    path = soc_path(requests(spark, 500), ["series_id", "scenario_id"])
    assert "Broadcast" not in plan(path)
    level, expected = 50.0, []
    for i in range(500):
        step = (25 * 0.95 * 0.25, 0.0, -25 / 0.95 * 0.25)[i % 3]
        level = max(10.0, min(100.0, level + step))
        expected.append(level)
    assert [r.soc_mwh for r in path.orderBy("pos").collect()] == pytest.approx(expected)


def test_chunks_of_rolling_schedules_are_joined_without_a_broadcast(spark):
    rows = spark.range(600).select(
        F.lit("a").alias("series_id"), F.col("id").alias("pos"), (50 + 20 * F.sin("id")).alias("predicted")
    )
    schedule = rolling_schedule(with_scenarios(rows, [Battery()]), ["series_id", "scenario_id"])
    assert "Broadcast" not in plan(schedule)
    assert schedule.count() == 600


def test_facts_beyond_the_bounds_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 3)
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (9, "w")], "k int, v string")
    facts = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (None, 40)], "k int, f int")
    joined = session.attach(rows, facts, ["k"])
    assert "Broadcast" not in plan(joined)
    assert {(r.v, r.f) for r in joined.collect()} == {("x", 10), ("y", 20), ("z", 40), ("w", None)}


def test_gaps_are_filled_by_frames_that_grow_row_by_row(spark):
    rng = np.random.default_rng(4)
    values = np.where(rng.random(300) < 0.2, rng.normal(size=300), np.nan)
    table = [("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(table, "k string, pos long, v double")
    filled = interpolate_rows(df, ["k"], ["v"], size=64)
    want = pd.Series(values).interpolate(limit_direction="both")
    assert [r.v for r in filled.orderBy("pos").collect()] == pytest.approx(list(want))


def test_no_window_looks_on_to_the_end_of_a_block(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("tidewatt.operators.interpolate.durable", lambda df: seen.append(plan(df)) or df)
    df = spark.range(10).select(F.lit("a").alias("k"), F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    interpolate_rows(df, ["k"], ["v"])
    assert "windowspecdefinition" in seen[0] and "unboundedfollowing" not in seen[0]
