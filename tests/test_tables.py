"""Parsing, cleaning, reports and summaries on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatt.functions import scalars as sc
from tidewatt.functions.labels import FEATURE_LABELS
from tidewatt.operators import metrics as mt
from tidewatt.operators.resample import collapse_duplicates
from tidewatt.operators.schedule import daily_schedule, perfect_foresight, rolling_schedule, settle_schedule
from tidewatt.plans import models as md, reports
from tidewatt.plans.features import MODEL_FEATURES
from tidewatt.plans.rules import action_log_backtest, rules_backtest, threshold_signal
from tidewatt.settings import Battery, Rules, Search, with_scenarios
from tidewatt.sources import tables


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("01/01/2024 24:00", dt.datetime(2024, 1, 2)),
        ("12/31/2024 24:00:00", dt.datetime(2025, 1, 1)),
        ("11/03/2024 02:00 DST", dt.datetime(2024, 11, 3, 2)),
        ("2024-05-06 07:00:00 CST", dt.datetime(2024, 5, 6, 7)),
        ("abc", None),
        (None, None),
    ],
)
def test_hour_ending(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(sc.parse_hour_ending("t").alias("x")).first().x == want


def test_autumn_hour_is_averaged(spark):
    utc = [(dt.datetime(2025, 11, 2, h), float(h)) for h in (5, 6, 7, 8)]
    df = spark.createDataFrame(utc, "t timestamp_ntz, v double")
    local = df.select(sc.utc_to_local("t").alias("time_stamp"), "v")
    got = {r.time_stamp.hour: r.v for r in collapse_duplicates(local, [], ["v"]).collect()}
    assert got == {0: 5.0, 1: 6.5, 2: 8.0}


def test_interval_start(spark):
    x = one(spark, sc.interval_start("d", "h", "i"), d="2024-02-29", h=24, i=4)
    assert x == dt.datetime(2024, 2, 29, 23, 45)


def test_ratio_edges(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "a double, b double")
    got = [r.x for r in rows.select(sc.ratio(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [float("inf"), float("-inf"), None, 0.25]


def test_every_model_feature_has_a_label():
    assert len(MODEL_FEATURES) == len(set(MODEL_FEATURES)) == 54
    assert set(MODEL_FEATURES) == set(FEATURE_LABELS)


def test_signal_charges_on_equal_thresholds(spark):
    rows = spark.createDataFrame(
        [(1.0, 1.0, 1.0), (2.0, 1.0, 2.0), (1.5, 1.0, 2.0), (1.0, None, None)],
        "predicted double, lower_threshold double, upper_threshold double",
    )
    assert [r.x for r in rows.select(threshold_signal().alias("x")).collect()] == ["charge", "discharge", "hold", "hold"]


def prices(spark, days=3):
    start = dt.datetime(2026, 1, 1)
    rows = []
    for i in range(96 * days - 6):
        p = 40 + 35 * ((i * 37) % 23 - 11) / 11
        rows.append(("a", i, start + dt.timedelta(minutes=15 * i), p, p + ((i * 13) % 7 - 3)))
    return spark.createDataFrame(rows, "series_id string, pos bigint, time_stamp timestamp_ntz, predicted double, actual double")


KEYS = ["series_id", "scenario_id"]


def test_planned_schedules_keep_the_rules(spark):
    rows = with_scenarios(prices(spark), [Battery()])
    planned = {
        "day": settle_schedule(daily_schedule(rows, KEYS), KEYS),
        "best": settle_schedule(perfect_foresight(rows, KEYS), KEYS),
        "roll": settle_schedule(rolling_schedule(rows, KEYS), KEYS),
    }
    totals = {}
    for name, df in planned.items():
        got = df.toPandas().sort_values("pos")
        assert len(got) == 96 * 3 - 6
        assert got.soc_mwh.between(10 - 1e-6, 100 + 1e-6).all()
        assert not ((got.charge_mw > 1e-6) & (got.discharge_mw > 1e-6)).any()
        assert max(got.charge_mw.max(), got.discharge_mw.max()) <= 25 + 1e-6
        if name != "roll":
            assert got.groupby(got.time_stamp.dt.date).soc_mwh.last().sub(50).abs().max() < 1e-9
        totals[name] = got.realized_revenue.sum()
        mt.require_clean(mt.schedule_checks(df, KEYS))
    assert totals["best"] >= totals["day"] > 0


def test_rolling_is_independent_of_chunks(spark, monkeypatch):
    from tidewatt.operators import schedule

    rows = with_scenarios(prices(spark), [Battery()])
    whole = rolling_schedule(rows, KEYS).orderBy("pos").select("soc_mwh").collect()
    monkeypatch.setattr(schedule, "CHUNK", 16)
    assert rolling_schedule(rows, KEYS).orderBy("pos").select("soc_mwh").collect() == whole


def test_summary_against_pandas(spark):
    dispatch = rules_backtest(prices(spark), ["series_id"], rules=Rules(window=48, minimum_history=8))
    s = mt.summary(dispatch, KEYS).first()
    got = dispatch.toPandas().sort_values("pos")
    equity = got.realized_revenue.cumsum()
    daily = got.groupby(got.time_stamp.dt.date).realized_revenue.sum()
    assert s.backtest_start == "2026-01-01T00:00:00" and s.backtest_days == 3 and s.intervals == len(got)
    assert s.maximum_drawdown_usd == pytest.approx(abs((equity - equity.cummax()).min()))
    assert s.annualized_daily_sharpe == pytest.approx(daily.mean() / daily.std() * 365**0.5)
    loss = -got.realized_revenue.clip(upper=0).sum()
    assert s.profit_factor == pytest.approx(got.realized_revenue.clip(lower=0).sum() / loss)
    assert s.median_daily_profit_usd == pytest.approx(daily.median())
    stored = 0.95 * s.total_charged_mwh - s.total_discharged_mwh / 0.95
    assert stored == pytest.approx(got.soc_mwh.iloc[-1] - 50)
    assert s.total_throughput_mwh == pytest.approx(s.total_charged_mwh + s.total_discharged_mwh)


def test_summary_of_an_idle_day(spark):
    log = prices(spark, 1).withColumn("action_code", F.lit(1))
    s = mt.summary(action_log_backtest(log, ["series_id"]), KEYS).first()
    assert s.annualized_daily_sharpe is None and s.profit_factor is None
    assert s.total_profit_usd == 0 and s.maximum_drawdown_usd == 0 and s.active_interval_percentage == 0


def test_unknown_action_is_refused(spark):
    log = prices(spark, 1).withColumn("action_code", F.lit(3))
    with pytest.raises(Exception, match="invalid action 3"):
        action_log_backtest(log, ["series_id"]).collect()


def test_duration_of_one_row_and_ties(spark):
    ts = dt.datetime(2024, 1, 1)
    rows = [("a", ts, 5.0)] + [("b", ts + dt.timedelta(hours=h), x) for h, x in enumerate([0.0, 3.0, 0.0, float("inf")])]
    df = spark.createDataFrame(rows, "k string, time_stamp timestamp_ntz, net double")
    got = reports.duration_curve(df, ["k"], "net").orderBy("k", "duration_percentile").collect()
    assert [(r.k, r.net_dispatch_mw, r.duration_percentile) for r in got] == [
        ("a", 5.0, 0.0), ("b", 3.0, 0.0), ("b", 0.0, 50.0), ("b", 0.0, 100.0)
    ]


def test_robust_scaling_edges(spark):
    df = spark.createDataFrame([("flat", 2.0), ("flat", 2.0), ("x", 0.0), ("x", 10.0), ("x", float("inf")), ("x", None)], "k string, v double")
    got = sorted((r.k, r.scaled) for r in reports.scale_robust(df, ["k"], "v").collect())
    assert got == [("flat", 0.5), ("flat", 0.5), ("x", 0.0), ("x", 0.5), ("x", 1.0), ("x", 1.0)]


def test_first_row_wins_ties(spark):
    days = spark.createDataFrame(
        [("a", dt.date(2024, 1, d), p) for d, p in ((1, 1.0), (2, 5.0), (3, 5.0), (4, 1.0))], "k string, date date, daily_profit double"
    )
    r = reports.extreme_days(days, ["k"]).first()
    assert (r.best_date.day, r.worst_date.day) == (2, 1)


def test_time_splits_expand():
    assert md.time_splits(13, 5) == [(3, 5), (5, 7), (7, 9), (9, 11), (11, 13)]
    picks = md.draw_settings(Search(draws=10))
    assert len(picks) == 10 and picks == md.draw_settings(Search(draws=10))


def test_weather_reads_every_file(spark, tmp_path):
    lines = "latitude,longitude\n29.7,-95.3\n\ntime,temperature\n"
    for day in (1, 2, 3):
        hours = "".join(f"2024-01-{day:02d}T{h:02d}:00,{h}.5,1,2,3,4,5\n" for h in range(24))
        (tmp_path / f"weather-{day}.csv").write_text(lines + hours)
    rows = tables.read_weather(spark, str(tmp_path))
    assert rows.count() == 72 and rows.select("time").distinct().count() == 72


def test_stage_is_reused_only_when_finished(spark, tmp_path):
    path = str(tmp_path / "stage")
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert tables.stage(spark, path, build).count() == 1
    assert tables.stage(spark, path, build).count() == 1 and len(built) == 1
    (tmp_path / "stage" / "_SUCCESS").unlink()
    assert tables.stage(spark, path, build).count() == 2
    assert tables.stage(spark, path, build, reuse=False).count() == 3


def test_share_of_each_batterys_own_capacity(spark):
    ts = dt.datetime(2024, 1, 1, 5)
    df = spark.createDataFrame(
        [("a", ts, 50.0, 100.0), ("b", ts, 20.0, 40.0)], "scenario_id string, time_stamp timestamp_ntz, soc_mwh double, capacity_mwh double"
    )
    got = {r.scenario_id: r.average_soc_percentage for r in reports.month_hour_profile(df, ["scenario_id"]).collect()}
    assert got == {"a": 50.0, "b": 50.0}


def test_folds_do_not_share_an_instant(spark):
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(24)]
    df = spark.createDataFrame(
        [(s, t, float(i), float(i)) for i, t in enumerate(ts) for s in ("a", "b", "c")], "s string, time_stamp timestamp_ntz, x double, y double"
    )
    _, table = md.random_search(df, ["x"], "y", "time_stamp", Search(draws=1, splits=3, grid={"maxIter": [1], "maxDepth": [2]}))
    assert table.count() == 3


def test_search_keeps_the_better_draws_and_agrees_with_the_whole_search(spark):
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(80)]
    df = spark.createDataFrame([(t, float(i % 8), float((i % 8) ** 2)) for i, t in enumerate(ts)], "time_stamp timestamp_ntz, x double, y double")
    grid = {"maxIter": [1, 8], "stepSize": [0.01, 0.9], "subsamplingRate": [1.0], "maxDepth": [1, 4]}
    whole, all_fits = md.random_search(df, ["x"], "y", search=Search(draws=6, splits=3, grid=grid))
    halved, some = md.random_search(df, ["x"], "y", search=Search(draws=6, splits=3, keep=2, parallel=2, grid=grid))
    # The first tree of depth 4 fits every value whatever the step, so the depth alone decides.
    assert whole == halved and whole["maxDepth"] == 4
    assert all_fits.count() == 18 and [some.filter(f"fold = {k}").count() for k in range(3)] == [6, 3, 2]
    assert set(map(tuple, some.collect())) <= set(map(tuple, all_fits.collect()))


def test_leaves_bound_the_depth():
    depths = {(n, d): md.estimator("boosting", leaves=n, maxDepth=d).getMaxDepth() for n in (12, 31, 45) for d in (-1, 4)}
    assert depths == {(12, -1): 4, (31, -1): 5, (45, -1): 6, (12, 4): 4, (31, 4): 4, (45, 4): 4}
    assert md.estimator("boosting", maxDepth=8).getMaxDepth() == 8


def test_profile_of_times_and_words(spark):
    ts = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(ts, "a", 1.0), (None, None, 2.0), (ts + dt.timedelta(days=3), "b", None)], "t timestamp_ntz, w string, v double")
    got = {r.column: r for r in reports.column_overview(df).collect()}
    assert (got["t"].first, got["t"].last) == ("2024-01-01 00:00:00", "2024-01-04 00:00:00")
    assert {c: r.nulls for c, r in got.items()} == {"t": 1, "w": 1, "v": 1} and got["w"].distinct == 2


def test_files_are_read_by_their_own_headings(spark, tmp_path):
    names = list(tables.PRICE_HEADINGS)
    (tmp_path / "a.csv").write_text(",".join(names) + '\n"HB, 1",01/02/2024,1,2,7.5\n')
    other = ["Repeated", *reversed(names)]
    (tmp_path / "b.csv").write_text("\ufeffnote\n" + ",".join(other) + "\nN,8.5,1,24,01/02/2024,HB2\nN,oops,4,1,01/02/2024,HB2\n")
    (tmp_path / "c.csv").write_text("")
    got = {(r.series_id, r.time_stamp): r.price for r in tables.read_prices(spark, str(tmp_path)).filter("time_stamp IS NOT NULL").collect()}
    assert got == {
        ("HB, 1", dt.datetime(2024, 1, 2, 0, 15)): 7.5,
        ("HB2", dt.datetime(2024, 1, 2, 23, 0)): 8.5,
        ("HB2", dt.datetime(2024, 1, 2, 0, 45)): None,
    }
    assert tables.read_prices(spark, str(tmp_path), ["HB2"]).count() == 2


def test_a_file_with_two_headings_is_refused_and_one_with_none_goes_by_order(spark, tmp_path):
    (tmp_path / "bare.csv").write_text("1,2\n3\n")
    rows = tables.read_by_heading(spark, str(tmp_path / "bare.csv"), ["a", "b"], ["a"]).collect()
    assert sorted(map(tuple, rows)) == [("1", "2"), ("3", None)]
    (tmp_path / "two.csv").write_text("a,b\n1,2\nb,a\n3,4\n")
    with pytest.raises(Exception, match="two headings"):
        tables.read_by_heading(spark, str(tmp_path / "two.csv"), ["a", "b"], ["a"]).collect()


SOUND = dict(soc_start_mwh=50.0, soc_mwh=50.0 + 10 * 0.25 * 0.95, charge_mw=10.0, discharge_mw=0.0)


@pytest.mark.parametrize(
    ("spoilt", "rules"),
    [
        ({}, []),
        ({"soc_mwh": None}, ["missing"]),
        ({"charge_mw": float("nan")}, ["missing"]),
        ({"soc_start_mwh": 5.0, "soc_mwh": 5.0 + 2.375}, ["below_minimum"]),
        ({"soc_start_mwh": 99.0, "soc_mwh": 99.0 + 2.375}, ["above_capacity"]),
        ({"discharge_mw": 9.5, "soc_mwh": 50.0 + 2.375 - 2.5}, ["simultaneous"]),
        ({"charge_mw": 40.0, "soc_mwh": 50.0 + 9.5}, ["over_power"]),
        ({"charge_mw": -10.0, "soc_mwh": 50.0 - 2.375}, ["negative_power"]),
        ({"soc_mwh": 60.0}, ["unbalanced"]),
    ],
)
def test_a_spoilt_schedule_is_refused(spark, spoilt, rules):
    good = with_scenarios(spark.range(200).select(*[F.lit(v).cast("double").alias(c) for c, v in SOUND.items()]), [Battery()])
    bad = with_scenarios(spark.range(1).select(*[F.lit(v).cast("double").alias(c) for c, v in (SOUND | spoilt).items()]), [Battery()])
    rows = good.unionByName(bad)
    if not rules:
        assert mt.checked(rows).count() == 201 and mt.checked(rows.limit(0)).count() == 0
        return
    with pytest.raises(ValueError, match="physical rules") as refused:
        mt.checked(rows)
    assert all(f"'{n}': 1" in str(refused.value) for n in rules) and str(refused.value).count(":") == 1 + len(rules)
