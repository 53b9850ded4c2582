"""Column helpers: parsing, calendar parts, cleaning and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Operating states and the words that stand for an action.
STATES = ("Discharge", "Idle", "Charge")
ACTIONS = ("Charge", "Hold", "Discharge")
ACTION_WORDS = {
    "hold": "Hold",
    "idle": "Hold",
    "charge": "Charge",
    "charging": "Charge",
    "discharge": "Discharge",
    "discharging": "Discharge",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def interval_start(date: Column | str, hour: Column | str, interval: Column | str, minutes: int = 15) -> Column:
    """Start of a delivery interval from its date, hour 1..24 and interval 1..n."""
    offset = F.make_dt_interval(
        F.lit(0), (col(hour) - 1).cast("int"), ((col(interval) - 1) * minutes).cast("int"), F.lit(0)
    )
    return F.to_date(col(date)).cast("timestamp_ntz") + offset


def strip_zone_suffix(text: Column | str) -> Column:
    """Remove a trailing daylight or standard time mark."""
    return F.trim(F.regexp_replace(col(text).cast("string"), " (DST|CST)", ""))


# Accepted spellings of a timestamp, tried in order.
TIME_FORMATS = (
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
    "MM/dd/yyyy",
    "yyyy-MM-dd",
)


def parse_mixed(text: Column | str, formats: tuple[str, ...] = TIME_FORMATS) -> Column:
    """Zone-free timestamp in any accepted spelling, null when none fits."""
    value = col(text)
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)).cast("timestamp_ntz") for f in formats])


def parse_hour_ending(text: Column | str) -> Column:
    """Hour-ending label to timestamp; 24:00 is midnight of the next day."""
    clean = strip_zone_suffix(text)
    pattern = r"\b24:00(?::00)?\b"
    parsed = parse_mixed(F.regexp_replace(clean, pattern, "00:00"))
    return F.when(clean.rlike(pattern), parsed + F.expr("INTERVAL '1' DAY")).otherwise(parsed)


def utc_to_local(ts: Column | str, zone: str = "America/Chicago") -> Column:
    """Zone-free local wall time of a zone-free UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(ts))


def calendar_parts(ts: str = "time_stamp") -> dict[str, Column]:
    """Hour, Monday-based weekday, month, weekend flag and their cycles."""
    hour, weekday, month = F.hour(ts), F.weekday(ts), F.month(ts)
    return {
        "hour": hour,
        "day_of_week": weekday,
        "month": month,
        "is_weekend": (weekday >= 5).cast("int"),
        **cycle("hour", hour, 24),
        **cycle("day_of_week", weekday, 7),
        **cycle("month", month - 1, 12),
    }


def cycle(name: str, value: Column, period: int) -> dict[str, Column]:
    angle = value * (2 * math.pi) / period
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def clock_cycle(ts: str = "time_stamp") -> dict[str, Column]:
    """Cycles of the fractional hour and the weekday."""
    return {
        **cycle("clock", F.hour(ts) + F.minute(ts) / 60.0, 24),
        **cycle("weekday", F.weekday(ts), 7),
    }


def iso_text(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def time_text(ts: Column | str, missing: str = "Unavailable") -> Column:
    return F.coalesce(F.date_format(col(ts), "MMM dd, yyyy HH:mm"), F.lit(missing))


def lenient_double(c: Column | str) -> Column:
    """Number or null; text that is no number, NaN and infinities become null."""
    return finite(col(c).try_cast("double"))


def finite(c: Column | str) -> Column:
    value = col(c)
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def nan_to_null(c: Column | str) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def ratio(top: Column, bottom: Column) -> Column:
    """Division where x/0 is signed infinity and 0/0 is null."""
    inf = F.lit(float("inf"))
    return (
        F.when(bottom != 0, top / F.when(bottom != 0, bottom))
        .when(top > 0, inf)
        .when(top < 0, -inf)
    )


def clip(c: Column | str, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    value = col(c)
    out = value if low is None else F.greatest(value, _lit(low))
    out = out if high is None else F.least(out, _lit(high))
    return F.when(value.isNotNull(), out)


def operating_state(net: Column | str, tolerance: float = 1e-6) -> Column:
    n = col(net)
    return F.when(n > tolerance, "Discharge").when(n < -tolerance, "Charge").otherwise("Idle")


def net_dispatch(net: str | None = None) -> Column:
    """A supplied net column, or discharge less charge."""
    return col(net) if net else F.col("discharge_mw") - F.col("charge_mw")


def action_from_text(c: Column | str) -> Column:
    """One of the three actions, or null for any other word."""
    words = F.create_map(*[F.lit(x) for pair in ACTION_WORDS.items() for x in pair])
    return F.try_element_at(words, F.lower(F.trim(col(c).cast("string"))))


def data_split(ts: Column | str, split) -> Column:
    """Band of a timestamp in the chronological split, null outside all bands."""
    year = F.year(col(ts))
    return (
        F.when(year <= split.train_end, "train")
        .when(year == split.test_year, "test")
        .when(year == split.backtest_year, "backtest")
    )


def _lit(v):
    return v if isinstance(v, Column) else F.lit(float(v))
