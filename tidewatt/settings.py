"""Plain parameter objects; every default is a fixed value of the backtest."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, functions as F

# Rows per block when a long series is cut for windowed work.  It must be at
# least as long as the longest look-back (672 rows plus one).
BLOCK_ROWS = 16_384

# Slot length of the common grid, in seconds (15 minutes).
SLOT_SECONDS = 900

# Look-backs of the engineered features, in rows.
PRICE_LAGS = (1, 4, 12, 24, 96, 672)
PRICE_WINDOWS = (4, 12, 24, 48, 96, 192, 672)
LOAD_STEPS = (1, 4)
LOAD_WINDOWS = (12, 96)
WEATHER_STEPS = (1, 4)


@dataclass(frozen=True)
class Battery:
    """One storage configuration."""

    scenario_id: str = "base"
    capacity_mwh: float = 100.0
    minimum_soc_mwh: float = 10.0
    initial_soc_mwh: float = 50.0
    max_charge_mw: float = 25.0
    max_discharge_mw: float = 25.0
    charge_efficiency: float = 0.95
    discharge_efficiency: float = 0.95
    interval_hours: float = 0.25
    degradation_cost_per_mwh: float = 5.0
    transaction_cost_per_mwh: float = 0.5

    def __post_init__(self) -> None:
        if not self.minimum_soc_mwh <= self.initial_soc_mwh <= self.capacity_mwh:
            raise ValueError("initial_soc_mwh must lie between minimum_soc_mwh and capacity_mwh")
        if not (0 < self.charge_efficiency <= 1 and 0 < self.discharge_efficiency <= 1):
            raise ValueError("efficiencies must lie in (0, 1]")

    @property
    def lattice(self) -> tuple[Fraction, int, int, int, int]:
        """(unit MWh, charge step, discharge step, top level, initial level).

        The unit is the largest energy quantum that divides both step limits
        and every bound, so whole units describe an optimal schedule exactly.
        """
        exact = {f.name: Fraction(str(getattr(self, f.name))) for f in fields(self) if f.name != "scenario_id"}
        sizes = (
            exact["max_charge_mw"] * exact["charge_efficiency"] * exact["interval_hours"],
            exact["max_discharge_mw"] * exact["interval_hours"] / exact["discharge_efficiency"],
            exact["capacity_mwh"] - exact["minimum_soc_mwh"],
            exact["initial_soc_mwh"] - exact["minimum_soc_mwh"],
        )
        bottom = lcm(*(s.denominator for s in sizes))
        whole = [int(s * bottom) for s in sizes]
        unit = Fraction(gcd(*whole) or 1, bottom)
        return (unit, *(int(s / unit) for s in sizes))


@dataclass(frozen=True)
class Rules:
    """Threshold strategy settings."""

    window: int = 672
    lower_quantile: float = 0.25
    upper_quantile: float = 0.75
    minimum_history: int = 96


@dataclass(frozen=True)
class Split:
    """Calendar years of the chronological split."""

    train_end: int = 2024
    test_year: int = 2025
    backtest_year: int = 2026


@dataclass(frozen=True)
class Boosting:
    """Gradient boosting settings."""

    rounds: int = 500
    step: float = 0.05
    depth: int = 6
    subsample: float = 0.8
    columns: float = 0.8
    seed: int = 42


@dataclass(frozen=True)
class Forest:
    trees: int = 200
    depth: int = 30
    seed: int = 42


# Value lists of the search over trees bounded by depth.
DEPTH_GRID = {
    "maxIter": [300, 500, 700, 900, 1100],
    "stepSize": [0.005, 0.01, 0.02, 0.03, 0.05],
    "maxDepth": [4, 5, 6, 8],
    "subsamplingRate": [0.8, 0.9, 1.0],
    "featureSubsetStrategy": ["0.45", "0.6", "0.75", "0.9", "1.0"],
    "minInstancesPerNode": [1, 3, 5, 7, 10],
    "minInfoGain": [0.0, 0.1, 0.3, 0.5],
}

# Value lists of the search over trees bounded by leaves; a depth of -1 is no bound.
LEAF_GRID = {
    "maxIter": [300, 500, 700, 900, 1100],
    "stepSize": [0.005, 0.01, 0.02, 0.03, 0.05],
    "leaves": [12, 15, 23, 31, 45],
    "maxDepth": [-1, 4, 5, 6],
    "minInstancesPerNode": [15, 30, 50, 75],
    "subsamplingRate": [0.8, 0.9, 1.0],
    "featureSubsetStrategy": ["0.45", "0.6", "0.75", "0.9", "1.0"],
}


@dataclass(frozen=True)
class Search:
    """Random search over boosting settings.

    After each split the best 1 / ``keep`` of the draws go on to the next; 1
    keeps them all.  ``parallel`` fits run at a time.
    """

    draws: int = 35
    splits: int = 5
    seed: int = 42
    keep: int = 1
    parallel: int = 4
    grid: dict = field(default_factory=lambda: dict(DEPTH_GRID))


BATTERY_COLUMNS = [f.name for f in fields(Battery)]


def with_scenarios(df: DataFrame, scenarios: list[Battery]) -> DataFrame:
    """Repeat every row once per scenario, with its battery columns and its start level on the lattice.

    The scenarios are a short list held by the caller, so they travel as a
    literal array inside the projection; no join takes place.
    """
    return df.withColumn("_s", F.explode(F.array(*[_literal(s) for s in scenarios]))).select(*df.columns, "_s.*")


def _literal(s: Battery) -> Column:
    level = F.lit(s.lattice[4]).cast("bigint").alias("initial_level")
    return F.struct(*[F.lit(getattr(s, c)).alias(c) for c in BATTERY_COLUMNS], level)
