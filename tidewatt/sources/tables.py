"""Reading raw series and writing results."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tidewatt.functions.scalars import (
    interval_start,
    lenient_double,
    parse_hour_ending,
    parse_mixed,
    utc_to_local,
)
from tidewatt.operators.resample import collapse_duplicates, fill_forward, shift_time
from tidewatt.session import attach, durable

# Headings of the raw files and the names used from then on.
PRICE_HEADINGS = {
    "Settlement Point Name": StringType(),
    "Delivery Date": StringType(),
    "Delivery Hour": IntegerType(),
    "Delivery Interval": IntegerType(),
    "Settlement Point Price": DoubleType(),
}
LOAD_HEADINGS = ("Hour Ending", "ERCOT", "COAST")
WEATHER_HEADINGS = {
    "temperature_2m (°C)": "temperature",
    "dew_point_2m (°C)": "dew_point",
    "wind_speed_10m (km/h)": "wind_speed",
    "cloud_cover (%)": "cloud_cover",
    "shortwave_radiation (W/m²)": "shortwave_radiation",
    "precipitation (mm)": "precipitation",
}

# Headings of the result tables.
RESULT_HEADINGS = {
    "actual": "Actual",
    "predicted": "Predicted",
    "error": "Error",
    "absolute_error": "Absolute Error",
    "charge_mw": "Charge MW",
    "discharge_mw": "Discharge MW",
    "soc_start_mwh": "SOC Start MWh",
    "soc_mwh": "SOC MWh",
    "degradation_cost": "Degradation Cost",
    "transaction_cost": "Transaction Cost",
    "gross_realized_revenue": "Gross Realized Revenue",
    "realized_revenue": "Realized Revenue",
    "cumulative_profit": "Cumulative Profit",
    "lower_threshold": "Lower Threshold",
    "upper_threshold": "Upper Threshold",
    "action": "Action",
    "model": "Model",
    "mae": "MAE",
    "rmse": "RMSE",
    "r2": "R2",
}


def result_headings(df: DataFrame) -> DataFrame:
    """Rename columns to the headings of the published result tables."""
    return df.withColumnsRenamed({k: v for k, v in RESULT_HEADINGS.items() if k in df.columns})


def read_csv(spark: SparkSession, paths: str | list[str], schema: StructType) -> DataFrame:
    """Headed CSV files; the heading line must agree with ``schema``."""
    return spark.read.schema(schema).csv(paths, header=True, enforceSchema=False)


def read_by_heading(
    spark: SparkSession, paths: str | list[str], columns: Iterable[str], required: Iterable[str]
) -> DataFrame:
    """Text columns of CSV files whose column order, width and preamble differ from file to file.

    A file's heading is its line whose cells hold every name in ``required``.
    The headings (one small row per file) are found in one scan and meet the
    lines by file name, so each line is cut by the heading of its own file.
    A column that a file lacks is null, further ones are left out.  A file
    without a heading is read in the order of ``columns``; two different
    headings in one file are refused.  Preamble lines come out as rows, for the
    caller to tell by their values; cells over several lines are not read.
    """
    columns, required = list(columns), list(required)
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"))
    likely = reduce(and_, [F.contains(F.col("value"), F.lit(n)) for n in required])
    candidates = durable(lines.filter(likely))
    width = max(len(columns), candidates.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 0)
    schema = ", ".join(f"c{i} string" for i in range(width))

    def cells(line: Column) -> Column:
        parsed = F.from_csv(F.ltrim(line, F.lit("\ufeff")), F.lit(schema))
        return F.array(*[F.trim(parsed[f"c{i}"]) for i in range(width)])

    is_heading = reduce(and_, [F.array_contains("_cells", n) for n in required])
    headings = (
        candidates.withColumn("_cells", cells(F.col("value")))
        .filter(is_heading)
        .groupBy("_file")
        .agg(F.collect_set("_cells").alias("_found"), F.collect_set("value").alias("_lines"))
    )
    found = attach(lines, headings, ["_file"])
    names = (
        F.when(F.size("_found") > 1, F.raise_error(F.concat(F.lit("two headings in "), F.col("_file"))).cast("array<string>"))
        .when(F.size("_found") == 1, F.element_at("_found", 1))
        .otherwise(F.array(*map(F.lit, columns)))
    )
    data = found.filter(~F.coalesce(F.array_contains("_lines", F.col("value")), F.lit(False)))
    cut = data.select(cells(F.col("value")).alias("_cells"), names.alias("_names"))
    at = {c: F.array_position("_names", F.lit(c)).cast("int") for c in columns}
    return cut.select(*[F.when(at[c] > 0, F.try_element_at("_cells", at[c])).alias(c) for c in columns])


def read_prices(spark: SparkSession, paths: str | list[str], series: Iterable[str] | None = None) -> DataFrame:
    """Interval prices of all files, as (series_id, time_stamp, price), by the names in each file's heading."""
    raw = read_by_heading(spark, paths, PRICE_HEADINGS, PRICE_HEADINGS)
    kinds = {n: F.col(n).try_cast(t) for n, t in PRICE_HEADINGS.items()}
    return prices_from_raw(raw.withColumns(kinds), series)


def prices_from_raw(raw: DataFrame, series: Iterable[str] | None = None) -> DataFrame:
    if series is not None:
        raw = raw.filter(F.col("Settlement Point Name").isin(list(series)))
    return raw.select(
        F.col("Settlement Point Name").alias("series_id"),
        interval_start(parse_mixed("Delivery Date"), "Delivery Hour", "Delivery Interval").alias("time_stamp"),
        lenient_double("Settlement Point Price").alias("price"),
    )


def read_load(spark: SparkSession, sheets: dict[str, Iterable[str]]) -> DataFrame:
    """Hourly load of several file groups whose columns differ.

    ``sheets`` maps a path or glob to its column names; absent columns are null.
    """
    frames = [
        read_csv(spark, path, StructType([StructField(c, StringType()) for c in columns]))
        for path, columns in sheets.items()
    ]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


def load_on_grid(raw: DataFrame, keys: list[str], shift_minutes: int = 45, seconds: int = 900) -> DataFrame:
    """Hour-ending load to the slot grid: parse, average repeats, shift, fill."""
    parsed = raw.select(
        *keys,
        parse_hour_ending("Hour Ending").alias("time_stamp"),
        lenient_double("ERCOT").alias("load"),
        lenient_double("COAST").alias("coast_load"),
    ).na.drop(subset=["time_stamp"])
    hourly = collapse_duplicates(parsed, keys, ["load", "coast_load"])
    return fill_forward(shift_time(hourly, shift_minutes), keys, seconds=seconds)


def read_weather(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Hourly weather of all files by each one's heading; the lines before the data drop out."""
    raw = read_by_heading(spark, paths, ["time", *WEATHER_HEADINGS], ["time"])
    # Preamble lines have no timestamp under the heading's time.
    return raw.filter(parse_mixed("time").isNotNull())


def weather_on_grid(
    raw: DataFrame, keys: list[str], zone: str = "America/Chicago", seconds: int = 900
) -> DataFrame:
    """UTC weather to local time on the slot grid; the repeated autumn hour is averaged."""
    local = raw.select(
        *keys,
        utc_to_local(parse_mixed("time"), zone).alias("time_stamp"),
        *[lenient_double(F.col(f"`{h}`")).alias(n) for h, n in WEATHER_HEADINGS.items()],
    )
    hourly = collapse_duplicates(local, keys, list(WEATHER_HEADINGS.values()))
    return fill_forward(hourly, keys, seconds=seconds)


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_by_series_year(df: DataFrame, path: str, ts: str = "time_stamp") -> None:
    """Partition by year so that a chronological split prunes folders.

    Series stay inside the files (sorted, so row groups skip): a folder per
    series would make millions of tiny files.
    """
    with_year = df.withColumn("year", F.year(ts))
    (
        with_year.repartitionByRange("year", "series_id", ts)
        .sortWithinPartitions("year", "series_id", ts)
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; null fields are written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], reuse: bool = True) -> DataFrame:
    """A written stage table: read when its write was finished and reuse is allowed, else built first."""
    if not (reuse and finished(spark, path)):
        write_parquet(build(), path)
    return spark.read.parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has committed: its success mark is there."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)
