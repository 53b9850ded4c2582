"""Scales that are fitted on one table and applied to another."""

from tidewatt.plans.scaling import ContextScaler, ContextScalerModel

SCHEMA = "id string, predicted double, forecast_rolling_mean double, forecast_rolling_volatility double"


def test_scales_of_one_table_apply_to_another_and_survive_a_save(spark, tmp_path):
    train = [("a", float(v), 0.0, float(v)) for v in range(21)] + [("flat", 5.0, 5.0, 0.0)] * 3 + [("lone", 1.0, 1.0, None)]
    model = ContextScaler(["id"]).fit(spark.createDataFrame(train, SCHEMA))
    model.save(str(tmp_path / "scales"))
    later = spark.createDataFrame(
        [("a", 10.0, 20.0, 9.5), ("a", 1e9, None, 1.9), ("flat", 7.0, 5.0, 3.0), ("lone", 0.0, 1.0, 2.0), ("new", 1.0, 1.0, 1.0)], SCHEMA
    )
    deviation = (sum((v - 10) ** 2 for v in range(21)) / 20) ** 0.5
    want = [
        ("a", 0.0, 10 / deviation, 0.5), ("a", 10.0, None, 0.1), ("flat", 2.0, 0.0, 3.0), ("lone", -1.0, 0.0, 2.0), ("new", None, None, None),
    ]
    for scaler in (model, ContextScalerModel.load(spark, str(tmp_path / "scales"))):
        got = scaler.transform(later)
        assert got.columns == [*later.columns, "forecast_scaled", "mean_scaled", "volatility_scaled"]
        key = lambda r: (r[0], r[1] is None, r[1] or 0.0)
        rows = [(r.id, r.forecast_scaled, r.mean_scaled, r.volatility_scaled) for r in got.collect()]
        assert [tuple(v if v is None or isinstance(v, str) else round(v, 9) for v in r) for r in sorted(rows, key=key)] == [
            tuple(v if v is None or isinstance(v, str) else round(v, 9) for v in r) for r in sorted(want, key=key)
        ]


def test_level_takes_its_own_battery_and_no_rows_give_no_rows(spark):
    model = ContextScaler(["id"]).fit(spark.createDataFrame([], SCHEMA))
    rows = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 55.0, 10.0, 100.0)], SCHEMA + ", soc_start_mwh double, minimum_soc_mwh double, capacity_mwh double")
    got = model.transform(rows).first()
    assert (got.level_scaled, got.forecast_scaled) == (0.5, None)
    assert model.transform(rows.limit(0)).count() == 0
