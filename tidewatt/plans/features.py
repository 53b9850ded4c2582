"""From raw series to the table of engineered features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from tidewatt.functions.scalars import calendar_parts, ratio
from tidewatt.operators.rolling import Trailing, look_back
from tidewatt.settings import (
    BLOCK_ROWS,
    LOAD_STEPS,
    LOAD_WINDOWS,
    PRICE_LAGS,
    PRICE_WINDOWS,
    WEATHER_STEPS,
)

# Measure column of each weather family.
WEATHER = {
    "temp": "temperature",
    "dew": "dew_point",
    "wind": "wind_speed",
    "cloud": "cloud_cover",
    "solar": "shortwave_radiation",
    "precip": "precipitation",
}

# The longest look-back plus the excluded current row.
LOOK_BACK = max(*PRICE_LAGS, *PRICE_WINDOWS, *LOAD_WINDOWS) + 1

PRICE = Trailing("price", "price", PRICE_WINDOWS)
LOAD = Trailing("load", "load", (*LOAD_WINDOWS, 24))
TEMP = Trailing("temp", WEATHER["temp"], (24,), offset=0)
WIND = Trailing("wind", WEATHER["wind"], (24,), offset=0)
SOLAR = Trailing("solar", WEATHER["solar"], (4, 24), offset=0)


def join_exogenous(price: DataFrame, load: DataFrame, weather: DataFrame, on: list[str]) -> DataFrame:
    """Price rows with the load and weather of their timestamp; no price row is lost."""
    return price.join(load, on, "left").join(weather, on, "left")


def with_lookback(
    df: DataFrame, keys: list[str], lags: dict, specs: list[Trailing], made: dict[str, Column],
    pos: str = "pos", size: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows with the columns ``made`` of ``lags`` and windows, over blocks that see the full look-back."""
    rows = look_back(df, keys, lags, specs, LOOK_BACK, pos, size)
    return rows.select(*df.columns, *[c.alias(name) for name, c in made.items()])


def price_features(df: DataFrame, keys: list[str], pos: str = "pos", size: int = BLOCK_ROWS) -> DataFrame:
    return with_lookback(df, keys, _PRICE_LAGS, [PRICE], _price(), pos, size)


def load_features(df: DataFrame, keys: list[str], pos: str = "pos", size: int = BLOCK_ROWS) -> DataFrame:
    return with_lookback(df, keys, _LOAD_LAGS, [LOAD], _load(), pos, size)


def weather_features(df: DataFrame, keys: list[str], pos: str = "pos", size: int = BLOCK_ROWS) -> DataFrame:
    return with_lookback(df, keys, _WEATHER_LAGS, [TEMP, WIND, SOLAR], _weather(), pos, size)


def all_features(df: DataFrame, keys: list[str], pos: str = "pos", size: int = BLOCK_ROWS) -> DataFrame:
    """Every feature in one shuffle and one pass over each block."""
    lags = {**_PRICE_LAGS, **_LOAD_LAGS, **_WEATHER_LAGS}
    made = {**_price(), **_load(), **_weather()}
    return with_lookback(df, keys, lags, [PRICE, LOAD, TEMP, WIND, SOLAR], made, pos, size).withColumns(calendar_parts())


def complete_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null or a NaN in any column (warm-up rows among them).

    Numbers are tested as one array: the code generated for a test of dozens of columns
    is too long a method to be compiled, and every row would be interpreted.
    """
    types = {f.name: f.dataType for f in df.schema.fields if subset is None or f.name in subset}
    numbers = [F.col(c).cast("double") for c, t in types.items() if isinstance(t, NumericType)]
    rest = [c for c, t in types.items() if not isinstance(t, NumericType)]
    if rest:
        df = df.na.drop("any", subset=rest)
    return df.filter(~F.exists(F.array(*numbers), lambda v: F.isnull(v) | F.isnan(v))) if numbers else df


# Lags to fetch: name, then column and rows back.
_PRICE_LAGS = {f"_price_{k}": ("price", k) for k in PRICE_LAGS}
_LOAD_LAGS = {f"_load_{k}": ("load", k) for k in sorted({1, *LOAD_STEPS, *(1 + s for s in LOAD_STEPS)})}
_WEATHER_LAGS = {
    **{f"_temp_{k}": (WEATHER["temp"], k) for k in WEATHER_STEPS},
    **{f"_{f}_1": (WEATHER[f], 1) for f in ("wind", "solar", "cloud", "dew", "precip")},
    **{f"_{f}_4": (WEATHER[f], 4) for f in ("wind", "solar", "cloud", "dew")},
}


def _mean(of: Trailing, k: int) -> Column:
    return F.col(of.mean_name(k))


def _std(of: Trailing, k: int) -> Column:
    return F.col(of.std_name(k))


def _price() -> dict[str, Column]:
    return {
        **{f"lag_{k}": F.col(f"_price_{k}") for k in PRICE_LAGS},
        **{f"rolling_mean_{k}": _mean(PRICE, k) for k in PRICE_WINDOWS},
        **{f"rolling_std_{k}": _std(PRICE, k) for k in PRICE_WINDOWS},
    }


def _load() -> dict[str, Column]:
    known = F.col("_load_1")
    earlier = {s: F.col(f"_load_{1 + s}") for s in LOAD_STEPS}
    return {
        **{f"load_lag_{k}": F.col(f"_load_{k}") for k in LOAD_STEPS},
        "known_load": known,
        **{f"load_rolling_mean_{k}": _mean(LOAD, k) for k in LOAD_WINDOWS},
        **{f"load_change_{s}": known - e for s, e in earlier.items()},
        **{f"load_pct_change_{s}": ratio(known - e, e) for s, e in earlier.items()},
        "load_deviation_96": known - _mean(LOAD, 96),
        "load_volatility_24": _std(LOAD, 24),
    }


def _weather() -> dict[str, Column]:
    def change(family, k):
        return F.col(WEATHER[family]) - F.col(f"_{family}_{k}")

    return {
        **{f"temp_lag_{k}": F.col(f"_temp_{k}") for k in WEATHER_STEPS},
        **{f"temp_change_{k}": change("temp", k) for k in WEATHER_STEPS},
        **{f"{f}_lag_1": F.col(f"_{f}_1") for f in ("wind", "solar", "cloud", "dew", "precip")},
        **{f"{f}_change_4": change(f, 4) for f in ("wind", "solar", "cloud", "dew")},
        "heat_index_proxy_1": F.col("_temp_1") + 0.2 * F.col("_dew_1"),
        "temp_rolling_mean_24": _mean(TEMP, 24),
        "temp_volatility_24": _std(TEMP, 24),
        "wind_rolling_mean_24": _mean(WIND, 24),
        "wind_volatility_24": _std(WIND, 24),
        "solar_rolling_mean_4": _mean(SOLAR, 4),
        "solar_volatility_24": _std(SOLAR, 24),
    }


# The model's inputs, computed features that it leaves out aside.
MODEL_FEATURES = [
    "hour", "day_of_week", "month",
    "lag_1", "lag_4", "lag_12", "lag_24", "lag_96", "lag_672",
    "is_weekend",
    "rolling_mean_4", "rolling_std_4",
    "rolling_mean_12", "rolling_std_12",
    "rolling_mean_24", "rolling_std_24",
    "rolling_mean_48", "rolling_std_48",
    "rolling_mean_96", "rolling_std_96",
    "rolling_mean_192", "rolling_std_192",
    "rolling_mean_672", "rolling_std_672",
    "hour_sin", "hour_cos",
    "day_of_week_sin", "day_of_week_cos",
    "month_sin", "month_cos",
    "load_change_1", "load_change_4",
    "load_deviation_96", "load_volatility_24",
    "temp_lag_1", "temp_lag_4",
    "temp_change_1", "temp_change_4",
    "temp_rolling_mean_24", "temp_volatility_24",
    "wind_lag_1", "wind_change_4",
    "wind_rolling_mean_24", "wind_volatility_24",
    "solar_lag_1", "solar_change_4",
    "solar_rolling_mean_4", "solar_volatility_24",
    "cloud_lag_1", "cloud_change_4",
    "dew_lag_1", "dew_change_4",
    "precip_lag_1", "heat_index_proxy_1",
]
