"""What the permutation of inputs leaves on disk."""

import time
from pathlib import Path

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatt.plans import features as ft, models as md
from tidewatt.registry import forecasts as fc
from tidewatt.session import DROP_SHUFFLES, durable, shuffles_dropped


def shuffled_bytes(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return sum(f.length() for f in found if f.getName().startswith("shuffle_"))


def settles(value, most: int) -> bool:
    """Files are removed in the background."""
    until = time.time() + 20
    while value() > most and time.time() < until:
        time.sleep(0.2)
    return value() <= most


def test_repeats_leave_no_moved_rows_on_disk(spark):
    df = spark.range(4000).select("id", *[F.sin(F.col("id") * (i + 3)).alias(f"x{i}") for i in range(20)])
    df = durable(df.withColumn("y", F.col("x0") - 2 * F.col("x1")))
    names = [f"x{i}" for i in range(20)]
    model = md.fit(df, names, "y", "linear")
    before = shuffled_bytes(spark)
    got = {r.feature: r.importance for r in md.permutation_importance(model, df, names, "y", ["id"], repeats=3).collect()}
    assert got["x1"] > got["x0"] > 0.5
    # A repeat moves 4,000 rows of 20 numbers twice, 1.3 MB; its errors are a few hundred bytes.
    assert settles(lambda: shuffled_bytes(spark) - before, 200_000)


def test_rows_that_the_model_learnt_from_go_before_the_exchange(spark, monkeypatch):
    values = F.array(*[F.sin(F.col("id") * (i + 3)) for i in range(len(ft.MODEL_FEATURES))])
    rows = spark.range(600).select(
        (F.col("id") % 2).cast("string").alias("series_id"),
        F.timestamp_seconds(F.col("id") * 900).cast("timestamp_ntz").alias("time_stamp"),
        (3 * F.sin(F.col("id") * 3)).alias("price"),
        array_to_vector(values).alias("features"),
    )
    written = []

    def learning(*_):
        table = durable(rows)
        written.extend(Path(f.removeprefix("file:")) for f in table.inputFiles())
        early = F.col("time_stamp") < F.lit("1970-01-05").cast("timestamp_ntz")
        return table.filter(early), table.filter(~early)

    monkeypatch.setattr(fc, "_learning", learning)
    got = fc.permutation_importance(spark, None).collect()
    assert max(got, key=lambda r: r.importance).feature == ft.MODEL_FEATURES[0]
    assert written and not any(f.exists() for f in written)


@pytest.mark.parametrize("before", [None, "false", "true"])
def test_the_sessions_own_setting_comes_back(spark, before):
    if before is not None:
        spark.conf.set(DROP_SHUFFLES, before)
    try:
        with pytest.raises(ZeroDivisionError), shuffles_dropped(spark):
            assert spark.conf.get(DROP_SHUFFLES) == "true"
            1 / 0
        assert spark.conf.get(DROP_SHUFFLES, None) == before
    finally:
        spark.conf.unset(DROP_SHUFFLES)
