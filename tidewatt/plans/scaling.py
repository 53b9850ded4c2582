"""Context on a common scale, fitted on one period and applied to others."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatt.functions.scalars import clip
from tidewatt.operators.quantiles import exact_quantiles
from tidewatt.session import attach, durable

#: Columns of a fitted table besides its keys.
FITTED = ["forecast_mean", "forecast_std", "volatility_scale"]

# A smaller scale counts as one, and scaled values stay within the bound.
LEAST_SCALE = 1e-8
BOUND = 10.0


class ContextScaler(Estimator):
    """Learns mean and deviation of the forecast and the 95 % quantile of its volatility per key.

    Rows need ``predicted`` and ``forecast_rolling_volatility``; null and
    missing values take no part.  A scale that is tiny, not finite or missing
    (one row, equal rows) counts as one.
    """

    def __init__(self, keys: list[str]):
        super().__init__()
        self.keys = list(keys)

    def _fit(self, dataset: DataFrame) -> ContextScalerModel:
        rows = durable(dataset.select(*self.keys, "predicted", "forecast_rolling_volatility"))
        stats = rows.groupBy(*self.keys).agg(
            F.avg("predicted").alias("forecast_mean"), F.stddev_samp("predicted").alias("forecast_std")
        )
        volatility = exact_quantiles(rows, self.keys, "forecast_rolling_volatility", {"volatility_scale": 0.95})
        table = attach(stats, volatility, self.keys).select(*self.keys, *FITTED)
        return ContextScalerModel(
            self.keys, durable(table.withColumns({c: _usable(c) for c in ("forecast_std", "volatility_scale")}))
        )


class ContextScalerModel(Model):
    """Adds the scaled context by a table of one row per key.

    Keys that the table lacks get null in the three forecast columns.  The
    level is scaled by its own battery's bounds, where the rows have them.
    """

    def __init__(self, keys: list[str], table: DataFrame):
        super().__init__()
        self.keys, self.table = list(keys), table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = attach(dataset, self.table.withColumnsRenamed({c: f"_{c}" for c in FITTED}), self.keys)
        mean, std = F.col("_forecast_mean"), F.col("_forecast_std")
        scaled = {
            "forecast_scaled": (F.col("predicted") - mean) / std,
            "mean_scaled": (F.col("forecast_rolling_mean") - mean) / std,
            "volatility_scaled": F.col("forecast_rolling_volatility") / F.col("_volatility_scale"),
        }
        if {"soc_start_mwh", "minimum_soc_mwh", "capacity_mwh"} <= set(dataset.columns):
            floor = F.col("minimum_soc_mwh")
            scaled["level_scaled"] = (F.col("soc_start_mwh") - floor) / (F.col("capacity_mwh") - floor)
        clipped = {n: clip(c, -BOUND, BOUND) for n, c in scaled.items()}
        return rows.withColumns(clipped).drop(*[f"_{c}" for c in FITTED])

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ContextScalerModel:
        table = spark.read.parquet(path)
        return cls([c for c in table.columns if c not in FITTED], table)


def _usable(name: str) -> Column:
    c = F.col(name)
    good = (c >= LEAST_SCALE) & (c < float("inf")) & ~F.isnan(c)
    return F.when(good, c).otherwise(F.lit(1.0)).alias(name)
