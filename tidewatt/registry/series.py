"""Queries on sources, parsing, calendar parts and grids."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidewatt.functions import scalars as sc
from tidewatt.operators.positions import number_rows
from tidewatt.operators.resample import floor_slot
from tidewatt.plans import reports
from tidewatt.registry import fixtures as fx
from tidewatt.registry.base import ORACLES, query, r, rounded, table
from tidewatt.session import shared_folder
from tidewatt.settings import Split
from tidewatt.sources import tables


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("price_scan", f"WITH {fx.SLOTS_SQL} SELECT series_id, time_stamp, {r('price')} FROM slots")
def price_scan(spark, folder):
    """Raw interval prices written as headed CSV files and read back."""
    path = scratch(spark, "prices")
    raw = fx.price_slots(spark, folder).select(
        F.col("series_id").alias("Settlement Point Name"),
        F.date_format("time_stamp", "MM/dd/yyyy").alias("Delivery Date"),
        (F.hour("time_stamp") + 1).alias("Delivery Hour"),
        (F.minute("time_stamp") / 15 + 1).cast("int").alias("Delivery Interval"),
        F.col("price").alias("Settlement Point Price"),
    )
    tables.write_csv(raw, path)
    return rounded(tables.read_prices(spark, path))


@query(
    "price_scan_chosen_series",
    f"WITH {fx.SLOTS_SQL} SELECT series_id, time_stamp, {r('price')} FROM slots WHERE series_id IN ('0-view', '0-click')",
)
def price_scan_chosen_series(spark, folder):
    """The scan kept to named settlement points."""
    raw = fx.price_slots(spark, folder).select(
        F.col("series_id").alias("Settlement Point Name"),
        F.date_format("time_stamp", "yyyy-MM-dd").alias("Delivery Date"),
        (F.hour("time_stamp") + 1).alias("Delivery Hour"),
        (F.minute("time_stamp") / 15 + 1).cast("int").alias("Delivery Interval"),
        F.col("price").cast("string").alias("Settlement Point Price"),
    )
    return rounded(tables.prices_from_raw(raw, ["0-view", "0-click"]))


def _hour_labels(df):
    """Hour-ending labels in the spellings found in load files."""
    midnight = F.hour("time_stamp") == 0
    eve = F.date_format(F.col("time_stamp") - F.expr("INTERVAL '1' DAY"), "MM/dd/yyyy")
    plain = F.date_format("time_stamp", "MM/dd/yyyy HH:mm")
    return (
        F.when(midnight, F.concat(eve, F.lit(" 24:00")))
        .when(F.hour("time_stamp") == 2, F.concat(plain, F.lit(" DST")))
        .when(F.hour("time_stamp") == 5, F.concat(plain, F.lit(" CST")))
        .when(F.hour("time_stamp") % 3 == 1, F.date_format("time_stamp", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(plain)
    )


@query(
    "load_scan",
    f"""WITH {fx.READINGS_SQL}{fx.LOAD_GRID_SQL}
    SELECT hub, time_stamp, {r('load')}, {r("CASE WHEN hub % 2 = 0 THEN coast_load END", 'coast_load')} FROM load_grid""",
)
def load_scan(spark, folder):
    """Two file groups with different columns, odd time labels, 15-minute grid."""
    hourly = fx.load_hourly(spark, folder)
    raw = hourly.select(
        F.col("hub").cast("string"), _hour_labels(hourly).alias("Hour Ending"),
        F.col("load").alias("ERCOT"), F.col("coast_load").alias("COAST"),
    )
    full, narrow = scratch(spark, "load"), scratch(spark, "load")
    tables.write_csv(raw.filter("CAST(hub AS INT) % 2 = 0"), full)
    tables.write_csv(raw.filter("CAST(hub AS INT) % 2 = 1").drop("COAST"), narrow)
    whole = tables.read_load(
        spark,
        {full: ["hub", "Hour Ending", "ERCOT", "COAST"], narrow: ["hub", "Hour Ending", "ERCOT"]},
    )
    return rounded(tables.load_on_grid(whole.withColumn("hub", F.col("hub").cast("bigint")), ["hub"]))


_ALL_WEATHER = [*fx.WEATHER_TYPES, "precipitation"]


def _hourly_weather(spark, folder) -> DataFrame:
    return (
        fx.readings(spark, folder)
        .groupBy(F.date_trunc("hour", "ts").alias("t"))
        .agg(
            *[
                F.log(1 + F.avg(F.when(F.col("event_type") == kind, F.col("value")))).cast("string").alias(name)
                for name, kind in fx.WEATHER_TYPES.items()
            ],
            F.log(1 + F.min("value")).cast("string").alias("precipitation"),
        )
        .select(F.date_format("t", "yyyy-MM-dd'T'HH:mm").alias("time"), *_ALL_WEATHER)
    )


@query(
    "weather_scan",
    f"""WITH {fx.READINGS_SQL},
    hourly AS (
      SELECT 1 AS k, (time_bucket(INTERVAL '1 hour', ts) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS time_stamp,
             {", ".join(f"ln(1 + avg(value) FILTER (event_type = '{t}')) AS {n}" for n, t in fx.WEATHER_TYPES.items())},
             ln(1 + min(value)) AS precipitation
      FROM readings GROUP BY ALL)
    {fx.filled_sql("g", "hourly", "k", ", ".join(f"s.{c}" for c in _ALL_WEATHER))}
    SELECT time_stamp, {", ".join(r(c) for c in _ALL_WEATHER)} FROM g""",
)
def weather_scan(spark, folder):
    """A weather file with preamble lines in UTC, read to a local 15-minute grid."""
    hourly = _hourly_weather(spark, folder)
    names = ["time", *tables.WEATHER_HEADINGS]
    preamble = spark.createDataFrame(
        [("latitude", "longitude"), ("29.7", "-95.3"), (None, None), tuple(names[:2])], "a string, b string"
    ).select(F.col("a").alias("time"), F.col("b").alias("temperature"), *[F.lit(None).cast("string").alias(c) for c in _ALL_WEATHER[1:]])
    path = scratch(spark, "weather")
    # Three files, each with its own preamble, that share out the days.
    parts = preamble.withColumn("part", F.explode(F.array(*map(F.lit, range(3)))))
    days = hourly.withColumn("part", F.substring("time", 9, 2).cast("int") % 3)
    parts.unionByName(days).write.partitionBy("part").csv(path)
    return rounded(tables.weather_on_grid(tables.read_weather(spark, f"{path}/part=*"), []))


@query("weather_scan_by_heading", ORACLES["weather_scan"])
def weather_scan_by_heading(spark, folder):
    """Three files, each with its own preamble and column order, one with a measure more."""
    hourly = _hourly_weather(spark, folder).withColumn("part", F.substring("time", 9, 2).cast("int") % 3)
    headings = dict(zip(["time", *_ALL_WEATHER], ["time", *tables.WEATHER_HEADINGS]))
    orders = [["time", *_ALL_WEATHER], [*reversed(_ALL_WEATHER), "extra", "time"], [_ALL_WEATHER[0], "time", *_ALL_WEATHER[1:]]]
    first = [
        (part, place, line)
        for part, order in enumerate(orders)
        for place, line in enumerate(["latitude,longitude", "29.7,-95.3", "", ",".join(headings.get(c, c) for c in order)])
    ]
    whole = hourly.withColumn("extra", F.lit("1"))
    each = [
        whole.filter(F.col("part") == part).select(
            "part", F.lit(9).alias("place"), F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in order]).alias("value")
        )
        for part, order in enumerate(orders)
    ]
    path = scratch(spark, "weather")
    preamble = spark.createDataFrame(first, "part int, place int, value string")
    lines = reduce(DataFrame.unionByName, [preamble, *each])
    lines.repartition("part").sortWithinPartitions("part", "place").drop("place").write.partitionBy("part").text(path)
    return rounded(tables.weather_on_grid(tables.read_weather(spark, f"{path}/part=*"), []))


# Days that bring the tables' January to a spring and an autumn with a change of the clocks.
_MOVED = {"spring": 60, "autumn": 300}


@query(
    "weather_scan_across_clock_changes",
    f"""WITH {fx.READINGS_SQL},
    hourly_utc AS (
      SELECT time_bucket(INTERVAL '1 hour', ts) AS t,
             {", ".join(f"ln(1 + avg(value) FILTER (event_type = '{t}')) AS {n}" for n, t in fx.WEATHER_TYPES.items())},
             ln(1 + min(value)) AS precipitation
      FROM readings GROUP BY ALL),
    hourly AS (
      SELECT period, ((t + to_days(days)) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS time_stamp,
             {", ".join(f"avg({c}) AS {c}" for c in _ALL_WEATHER)}
      FROM hourly_utc, (VALUES {", ".join(f"('{n}', {d})" for n, d in _MOVED.items())}) p(period, days) GROUP BY 1, 2)
    {fx.filled_sql("g", "hourly", "period", ", ".join(f"s.{c}" for c in _ALL_WEATHER))}
    SELECT period, time_stamp, {", ".join(r(c) for c in _ALL_WEATHER)} FROM g""",
)
def weather_scan_across_clock_changes(spark, folder):
    """UTC weather to local time where an hour is left out in spring and comes twice in autumn."""
    periods = F.array(*[F.struct(F.lit(n).alias("period"), F.lit(d).alias("days")) for n, d in _MOVED.items()])
    moved = _hourly_weather(spark, folder).withColumn("_p", F.explode(periods)).select(
        "_p.period",
        F.date_format(F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd'T'HH:mm")) + F.make_interval(days=F.col("_p.days")), "yyyy-MM-dd'T'HH:mm").alias("time"),
        *[F.col(n).alias(h) for h, n in tables.WEATHER_HEADINGS.items()],
    )
    return rounded(tables.weather_on_grid(moved, ["period"]))


@query(
    "duplicate_slots_averaged",
    f"WITH {fx.SLOTS_SQL} SELECT hub, series_id, time_stamp, {r('price')} FROM slots",
)
def duplicate_slots_averaged(spark, folder):
    return rounded(fx.price_slots(spark, folder))


@query("price_on_grid", f"WITH {fx.GRID_SQL} SELECT hub, series_id, time_stamp, pos, {r('price')} FROM price_grid")
def price_on_grid(spark, folder):
    return rounded(fx.price_grid(spark, folder))


@query(
    "hour_ending_labels",
    """SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) + INTERVAL 1 HOUR AS hour_ending FROM orders""",
)
def hour_ending_labels(spark, folder):
    """Parse labels with zone marks, 24:00 and mixed formats."""
    hours = table(spark, folder, "orders").select(
        "o_orderkey",
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24 + 1).cast("int"))).alias("time_stamp"),
    )
    return hours.select("o_orderkey", sc.parse_hour_ending(_hour_labels(hours)).alias("hour_ending"))


@query(
    "number_rows_by_priority",
    """SELECT o_orderkey, o_orderpriority,
              row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS pos
       FROM orders""",
)
def number_rows_by_priority(spark, folder):
    """Five hot keys over the whole table: positions without a one-task sort."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return number_rows(orders, ["o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


_MOMENT = "o_orderdate + INTERVAL 15 MINUTE * (o_orderkey % 96)"


@query(
    "calendar_parts",
    f"""SELECT o_orderkey, hour(m)::INT AS hour, ((dayofweek(m) + 6) % 7)::INT AS day_of_week, month(m)::INT AS month,
        CASE WHEN (dayofweek(m) + 6) % 7 >= 5 THEN 1 ELSE 0 END::INT AS is_weekend,
        {r('sin(hour(m) * 2 * pi() / 24)', 'hour_sin')}, {r('cos(hour(m) * 2 * pi() / 24)', 'hour_cos')},
        {r('sin(((dayofweek(m) + 6) % 7) * 2 * pi() / 7)', 'day_of_week_sin')},
        {r('cos(((dayofweek(m) + 6) % 7) * 2 * pi() / 7)', 'day_of_week_cos')},
        {r('sin((month(m) - 1) * 2 * pi() / 12)', 'month_sin')}, {r('cos((month(m) - 1) * 2 * pi() / 12)', 'month_cos')},
        {r('sin((hour(m) + minute(m) / 60.0::DOUBLE) * 2 * pi() / 24)', 'clock_sin')},
        {r('cos((hour(m) + minute(m) / 60.0::DOUBLE) * 2 * pi() / 24)', 'clock_cos')},
        strftime(m, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(m, '%b') AS month_label, strftime(m, '%Y-%m') AS year_month,
        m::DATE AS date
        FROM (SELECT o_orderkey, {_MOMENT} AS m FROM orders)""",
)
def calendar_parts(spark, folder):
    step = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 96 * 15).cast("int"))
    rows = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderdate") + step).alias("time_stamp"))
    clock = {k: v for k, v in sc.clock_cycle().items() if k.startswith("clock")}
    rows = rows.withColumns({**sc.calendar_parts(), **clock}).withColumns(
        {
            "iso": sc.iso_text("time_stamp"),
            "month_label": F.date_format("time_stamp", "MMM"),
            "year_month": F.date_format("time_stamp", "yyyy-MM"),
            "date": F.to_date("time_stamp"),
        }
    )
    return rounded(rows.drop("time_stamp"))


@query(
    "lenient_numbers",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 NOT IN (1, 2, 3) THEN o_totalprice END AS number,
        {r("CASE WHEN o_orderkey % 7 NOT IN (1, 2, 3) THEN least(greatest(o_totalprice, 1000), 400000) END", 'clipped')},
        CASE WHEN o_orderkey % 7 = 5 THEN o_orderdate END AS moment
        FROM orders""",
)
def lenient_numbers(spark, folder):
    """Numbers and times out of text with junk, NaN and infinities."""
    kind = F.col("o_orderkey") % 7
    text = F.when(kind == 1, "abc").when(kind == 2, "NaN").when(kind == 3, "-Infinity").otherwise(F.col("o_totalprice").cast("string"))
    moment = F.when(kind == 5, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("not a time")
    rows = table(spark, folder, "orders").select("o_orderkey", sc.lenient_double(text).alias("number"), moment.alias("t"))
    return rounded(
        rows.select(
            "o_orderkey", "number", sc.clip("number", 1000.0, 400000.0).alias("clipped"), sc.parse_mixed("t").alias("moment")
        ),
        "clipped",
    )


@query(
    "action_words",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Charge' WHEN '2-HIGH' THEN 'Discharge'
              WHEN '3-MEDIUM' THEN 'Hold' WHEN '4-NOT SPECIFIED' THEN 'Hold' END AS action FROM orders""",
)
def action_words(spark, folder):
    """Free-text actions in several spellings; an unknown word gives null."""
    p = F.col("o_orderpriority")
    word = (
        F.when(p == "1-URGENT", "  Charging").when(p == "2-HIGH", "DISCHARGE ").when(p == "3-MEDIUM", "idle")
        .when(p == "4-NOT SPECIFIED", " Hold ").otherwise(p)
    )
    return table(spark, folder, "orders").select("o_orderkey", sc.action_from_text(word).alias("action"))


@query(
    "chronological_split",
    f"""SELECT split, count(*) AS n, {r('sum(o_totalprice)', 'total', 2)}
        FROM (SELECT *, CASE WHEN year(o_orderdate) <= 1998 THEN 'train' WHEN year(o_orderdate) = 1999 THEN 'test'
                        WHEN year(o_orderdate) = 2000 THEN 'backtest' END AS split FROM orders)
        WHERE split IS NOT NULL GROUP BY split""",
)
def chronological_split(spark, folder):
    """Written by year, then read per band with folder pruning."""
    path = scratch(spark, "by-year")
    rows = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("time_stamp"), "o_totalprice"
    )
    tables.write_by_series_year(rows, path)
    split = Split(1998, 1999, 2000)
    bands = sc.data_split("time_stamp", split)
    read = spark.read.parquet(path).filter(F.col("year") <= split.backtest_year)
    return rounded(
        read.withColumn("split", bands).filter("split IS NOT NULL").groupBy("split")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")),
        digits=2,
    )


@query(
    "stage_reuse",
    "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
)
def stage_reuse(spark, folder):
    """A stage is built once and read from its table the second time."""
    path = scratch(spark, "stage")

    def build():
        return table(spark, folder, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))

    def refuse():
        raise RuntimeError("the stage table was not reused")

    tables.stage(spark, path, build)
    return tables.stage(spark, path, refuse)


@query(
    "duplicate_report",
    f"""WITH {fx.READINGS_SQL}
    SELECT series_id, time_stamp, count(*) AS rows, {r('avg(price)', 'mean')}, {r('stddev_samp(price)', 'std')},
           {r('min(price)', 'min')}, {r('max(price)', 'max')}
    FROM (SELECT series_id, time_bucket(INTERVAL '15 minutes', ts) AS time_stamp, price FROM readings)
    GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_report(spark, folder):
    return rounded(reports.duplicate_report(_slotted(spark, folder), ["series_id"], "price"))


def _slotted(spark, folder):
    return fx.readings(spark, folder).withColumn("time_stamp", floor_slot("ts"))


@query(
    "duplicate_share",
    f"""WITH {fx.READINGS_SQL},
    per AS (SELECT series_id, time_bucket(INTERVAL '15 minutes', ts) AS time_stamp, count(*) AS c FROM readings GROUP BY ALL)
    SELECT series_id, sum(c)::BIGINT AS rows, count(*) FILTER (c > 1) AS repeated_timestamps, sum(c - 1)::BIGINT AS extra_rows,
           {r('count(*) FILTER (c > 1) / sum(c) * 100', 'repeated_percentage')}
    FROM per GROUP BY 1""",
)
def duplicate_share(spark, folder):
    return rounded(reports.duplicate_share(_slotted(spark, folder), ["series_id"]))


_PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "table_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", count(*) - count({c}) AS nulls, {r(f'avg({c})', 'mean')},
            {r(f'stddev_samp({c})', 'std')}, {r(f'min({c})', '"min"')}, {r(f'max({c})', '"max"')},
            {r(f'quantile_cont({c}, 0.25)', 'p25')}, {r(f'quantile_cont({c}, 0.5)', 'p50')}, {r(f'quantile_cont({c}, 0.75)', 'p75')}
            FROM lineitem"""
        for c in _PROFILED
    ),
)
def table_profile(spark, folder):
    return rounded(reports.table_profile(table(spark, folder, "lineitem"), _PROFILED))


@query(
    "column_overview",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS "distinct",
            min({c})::VARCHAR AS "first", max({c})::VARCHAR AS "last" FROM orders"""
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    ),
)
def column_overview(spark, folder):
    """Range, nulls and distinct values of columns of any kind, time among them."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return reports.column_overview(orders)


@query("distinct_days", "SELECT DISTINCT (user_id // 100) || '-' || event_type AS series_id, ts::DATE AS date FROM events")
def distinct_days(spark, folder):
    """The days that every series has readings of."""
    return fx.readings(spark, folder).select("series_id", F.to_date("ts").alias("date")).distinct()


@query(
    "keep_last_reading",
    f"""WITH {fx.READINGS_SQL}
    SELECT series_id, time_stamp, event_id, value FROM (
      SELECT *, row_number() OVER (PARTITION BY series_id, time_stamp ORDER BY event_id DESC) AS k
      FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS time_stamp FROM readings)) WHERE k = 1""",
)
def keep_last_reading(spark, folder):
    rows = fx.readings(spark, folder).select("series_id", floor_slot("ts", 3600).alias("time_stamp"), "event_id", "value")
    return reports.keep_last(rows, ["series_id"], "time_stamp", "event_id")


@query(
    "seeded_sample",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42-' || o_orderkey), o_orderkey LIMIT 500""",
)
def seeded_sample(spark, folder):
    return reports.seeded_sample(table(spark, folder, "orders"), ["o_orderkey"], 500).select("o_orderkey", "o_totalprice")
