"""Block-wise windows and scans against pandas on whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatt.operators.blocks import block_window, drop_copies, running, with_blocks
from tidewatt.operators.interpolate import interpolate_rows
from tidewatt.operators.positions import number_rows
from tidewatt.operators.quantiles import exact_quantiles
from tidewatt.operators.resample import fill_forward
from tidewatt.operators.rolling import Trailing, add_trailing, drop_states, look_ahead, look_back, rolling_quantiles
from tidewatt.operators.soc import soc_path
from tidewatt.plans.features import complete_rows
from tidewatt.plans.reports import align_profits
from tidewatt.plans.rules import action_log_backtest, market_context
from tidewatt.session import _WRITTEN
from tidewatt.settings import Battery, with_scenarios


@pytest.fixture(scope="module")
def series():
    """One hot series and small ones, with gaps in the values."""
    rng = np.random.default_rng(1)
    parts = []
    for name, n in (("hot", 2_000), ("warm", 300), ("single", 1)):
        v = rng.normal(0, 10, n).round(2)
        v[rng.random(n) < 0.02] = np.nan
        parts.append(pd.DataFrame({"k": name, "pos": np.arange(n) + 7, "v": v}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, series):
    return spark.createDataFrame(series).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(3)


def groups(df):
    for _, part in df.toPandas().groupby("k"):
        yield part.sort_values("pos").reset_index(drop=True)


def test_trailing_statistics(frame):
    specs = [Trailing("a", "v", (4, 12, 50, 96)), Trailing("b", "v", (24,), offset=0), Trailing("c", "v", (30,), minimum=1)]
    rows = add_trailing(with_blocks(frame, before=97, size=128), block_window(["k"]), specs)
    rows = rows.withColumns(
        {f"{s.name}{k}_{f}": getattr(s, f)(k) for s in specs for k in s.windows for f in ("mean", "std")}
    )
    for part in groups(drop_copies(drop_states(rows, specs))):
        prior = part.v.shift(1)
        for k in (4, 12, 50, 96):
            np.testing.assert_allclose(part[f"a{k}_mean"], prior.rolling(k).mean(), atol=1e-9)
            np.testing.assert_allclose(part[f"a{k}_std"], prior.rolling(k).std(), atol=1e-9)
        np.testing.assert_allclose(part.b24_std, part.v.rolling(24).std(), atol=1e-9)
        np.testing.assert_allclose(part.c30_mean, prior.rolling(30, min_periods=1).mean(), atol=1e-9)
        np.testing.assert_allclose(part.c30_std, prior.rolling(30, min_periods=2).std(), atol=1e-9)


def test_rolling_quantiles(frame):
    rows = rolling_quantiles(frame, ["k"], "v", {"lo": 0.25, "hi": 0.75}, 96, 10, size=128)
    for part in groups(rows):
        trail = part.v.shift(1).rolling(96, min_periods=10)
        np.testing.assert_allclose(part.lo, trail.quantile(0.25), atol=1e-9)
        np.testing.assert_allclose(part.hi, trail.quantile(0.75), atol=1e-9)


def test_running_values_in_small_blocks(frame):
    filled = frame.na.fill(0.0, ["v"])
    rows = running(filled, ["k"], {"s": ("sum", "v"), "m": ("max", "v"), "l": ("min", "v")}, size=16)
    for part in groups(rows):
        np.testing.assert_allclose(part.s, part.v.cumsum(), atol=1e-9)
        np.testing.assert_allclose(part.m, part.v.cummax())
        np.testing.assert_allclose(part.l, part.v.cummin())


def test_look_ahead_shortens_at_the_end(frame):
    rows = look_ahead(frame.na.fill(0.0, ["v"]), ["k"], "v", 5, size=64)
    for part in groups(rows):
        for i in (0, len(part) // 2, len(part) - 1):
            assert list(part.ahead[i]) == list(part.v[i : i + 5])


def test_positions_of_a_hot_key(frame):
    rows = number_rows(frame.drop("pos").withColumn("o", F.monotonically_increasing_id()), ["k"], ["o"])
    for _, part in rows.toPandas().groupby("k"):
        assert list(part.sort_values("o").pos) == list(range(len(part)))


def test_positions_spread_copies(spark):
    df = spark.range(8_000).select(F.lit("a").alias("k"), F.lit(1.0).alias("v"))
    spread = number_rows(df, ["k"], ["v"], copies=True)
    sizes = [len(p) for p in spread.rdd.glom().collect()]
    assert sorted(r.pos for r in spread.collect()) == list(range(8_000))
    assert max(sizes) < 4_000


def test_interpolation_by_position(frame):
    for part in groups(interpolate_rows(frame.withColumn("raw", F.col("v")), ["k"], ["v"], size=32)):
        np.testing.assert_allclose(part.v, part.raw.interpolate(limit_direction="both"), atol=1e-9)


def test_exact_quantiles_with_copies(spark):
    rng = np.random.default_rng(2)
    v = np.where(rng.random(60_000) < 0.35, 5.0, rng.normal(5, 3, 60_000))
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": v})).repartition(4)
    qs = {"a": 0.005, "b": 0.25, "c": 0.5, "d": 0.995, "e": 1.0, "f": 0.0}
    got = exact_quantiles(df, ["k"], "v", qs).first()
    for name, q in qs.items():
        assert got[name] == pytest.approx(np.quantile(v, q), abs=1e-12)


def test_exact_quantiles_ranked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("tidewatt.operators.quantiles.FIT", 100)
    test_exact_quantiles_with_copies(spark)
    test_exact_quantiles_of_tiny_groups(spark)


def test_exact_quantiles_of_tiny_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", None)], "k string, v double")
    got = {r.k: r.m for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 1.0, "b": 1.5}


def test_fill_forward_equals_pandas(spark):
    stamps = pd.to_datetime(
        ["2024-01-01 00:15", "2024-01-01 01:15", "2024-01-01 03:15", "2024-01-02 09:15", "2024-01-02 09:45"]
    )
    raw = pd.DataFrame({"k": "a", "time_stamp": stamps, "v": [1.0, 2.0, 3.0, 4.0, 5.0]})
    df = spark.createDataFrame(raw).withColumn("time_stamp", F.col("time_stamp").cast("timestamp_ntz"))
    got = fill_forward(df, ["k"], size=4).toPandas().sort_values("time_stamp")
    want = raw.set_index("time_stamp")[["v"]].resample("15min").ffill()
    assert list(got.time_stamp) == list(want.index)
    assert list(got.v) == list(want.v)


def test_a_stray_timestamp_is_filled_by_many_tasks(spark):
    rows = [("a", "1974-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:00:00", 2.0), ("b", "2024-01-01 00:30:00", 3.0), ("b", "2024-01-01 01:00:00", 4.0)]
    df = spark.createDataFrame(rows, "k string, t string, v double").select("k", F.col("t").cast("timestamp_ntz").alias("time_stamp"), "v")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        grid = fill_forward(df, ["k"]).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in grid.groupBy("part").count().collect()]
        by_key = {r.k: r for r in grid.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("time_stamp").alias("d"), F.sum("v").alias("s")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    slots = 18_262 * 96 + 1  # 50 years
    assert by_key["a"].n == by_key["a"].d == slots and by_key["a"].s == slots + 1
    assert by_key["b"].n == 3 and by_key["b"].s == 10.0
    assert len(sizes) == tasks and max(sizes) < 0.5 * slots


def test_running_reads_its_input_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        calls.add(1)
        return float(v)

    df = spark.range(1_000).select(F.lit("a").alias("k"), F.col("id").alias("pos"), counted("id").alias("v"))
    before = len(_WRITTEN)
    got = running(df, ["k"], {"s": ("sum", "v"), "m": ("max", "v")}, size=64).collect()
    assert calls.value == 1_000 and len(_WRITTEN) > before
    assert all((r.s, r.m) == (r.pos * (r.pos + 1) / 2, float(r.pos)) for r in got) and len(got) == 1_000
    exclusive = running(df, ["k"], {"s": ("sum", "v")}, size=64, inclusive=False).collect()
    assert all(r.s == (r.pos * (r.pos - 1) / 2 if r.pos else None) for r in exclusive)


def test_profits_are_aligned_by_pandas_rules(spark):
    rng = np.random.default_rng(9)
    stamps = pd.date_range("2024-03-01", periods=400, freq="15min")
    wide = pd.DataFrame({n: np.where(rng.random(400) < share, rng.normal(size=400), np.nan) for n, share in (("a", 0.9), ("b", 0.3), ("c", 0.02))}, index=stamps)
    wide = wide.dropna(how="all")
    frames = {}
    for n in "abc":
        part = wide[n].dropna().rename("cumulative_profit").rename_axis("time_stamp").reset_index().assign(k="x")
        frames[n] = spark.createDataFrame(part).withColumn("time_stamp", F.col("time_stamp").cast("timestamp_ntz"))
    got = align_profits(frames, ["k"]).orderBy("time_stamp").toPandas()
    want = wide.reset_index(drop=True).interpolate(limit_direction="both")
    np.testing.assert_allclose(got[["a", "b", "c"]], want, atol=1e-9)
    none = {n: f.limit(0) for n, f in frames.items()}
    assert align_profits(none, ["k"]).count() == 0


def test_replay_carries_only_what_is_read(spark):
    log = spark.createDataFrame(
        [("a", i, 5.0 + i, 5.0, i % 3, "note") for i in range(200)], "k string, pos long, actual double, predicted double, action_code int, remark string"
    ).withColumn("time_stamp", F.timestamp_seconds(F.col("pos") * 900).cast("timestamp_ntz"))
    whole = action_log_backtest(log, ["k"]).orderBy("pos")
    short = action_log_backtest(log, ["k"], columns=["realized_revenue"]).orderBy("pos")
    assert "remark" in whole.columns and not {"remark", "predicted", "cumulative_profit"} & set(short.columns)
    assert [r.realized_revenue for r in whole.collect()] == [r.realized_revenue for r in short.collect()]
    assert "realized_revenue" not in action_log_backtest(log, ["k"], columns=["action"]).columns


def test_soc_path_equals_loop(spark):
    rng = np.random.default_rng(5)
    # 9,300 rows need two levels of blocks of 96.
    wishes = rng.choice(["charge", "discharge", "hold"], 9_300, p=[0.35, 0.3, 0.35])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "pos": np.arange(len(wishes)), "request": wishes}))
    got = soc_path(with_scenarios(df, [Battery()]), ["k", "scenario_id"]).toPandas().sort_values("pos")
    soc = 50.0
    for wish, before, after in zip(got.request, got.soc_start_mwh, got.soc_mwh):
        assert before == pytest.approx(soc, abs=1e-8)
        soc += {"charge": 25 * 0.95 * 0.25, "discharge": -25 / 0.95 * 0.25, "hold": 0.0}[wish]
        soc = min(100.0, max(10.0, soc))
        assert after == pytest.approx(soc, abs=1e-8)
    assert len(got) == len(wishes)


def test_market_context_first_rows(spark):
    p = [3.0, 5.0, 4.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(p)], "k string, pos bigint, predicted double")
    rows = market_context(df, ["k"]).orderBy("pos").collect()
    assert [r.forecast_rolling_mean for r in rows] == [3.0, 3.0, 4.0]
    assert [round(r.forecast_rolling_volatility, 9) for r in rows] == [0.0, 0.0, round(2**0.5, 9)]


def test_look_back_gives_what_wide_windows_give(spark):
    """Gaps, NaN and block edges included; the pass is one exchange and no window operator."""
    rows = spark.range(400).select(
        (F.col("id") % 2).alias("k"),
        F.col("id").alias("pos"),
        F.when(F.col("id") % 61 == 7, None).when(F.col("id") % 89 == 8, float("nan")).otherwise(F.sin("id") * 50).alias("x"),
        F.when(F.col("id") % 53 != 9, F.col("id")).alias("whole"),
    )
    specs = [Trailing("a", "x", (4, 12)), Trailing("b", "whole", (6,), offset=0)]
    got = look_back(rows, ["k"], {"back": ("whole", 5)}, specs, 20, size=64)
    wide = add_trailing(with_blocks(rows, before=20, size=64), block_window(["k"]), specs)
    wide = drop_copies(wide.withColumn("back", F.lag("whole", 5).over(block_window(["k"]))))
    made = [(s.mean_name(k), s.std_name(k), s.mean(k), s.std(k)) for s in specs for k in s.windows]
    want = wide.select("k", "pos", "x", "whole", "back", *[c.alias(n) for m, d, mean, std in made for n, c in ((m, mean), (d, std))])
    assert got.columns == want.columns and dict(got.dtypes)["back"] == "bigint"
    text = lambda df: sorted(str(tuple(r)) for r in df.collect())  # NaN equals itself as text
    assert text(got) == text(want)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_complete_rows_drops_nulls_and_nan_of_any_type(spark):
    rows = [("a", 1, 1.0), (None, 1, 1.0), ("a", None, 1.0), ("a", 1, None), ("a", 1, float("nan"))]
    df = spark.createDataFrame(rows, "s string, i int, d double")
    assert [tuple(r) for r in complete_rows(df).collect()] == rows[:1]
    assert complete_rows(df, ["s"]).count() == 4 and complete_rows(df, ["i", "d"]).count() == 2
