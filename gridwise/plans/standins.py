"""Forecast tables for the decision queries, computed from the readings by formulas that SQL can repeat.

They replace fitted models where a result must be checked value by value: solar is the last clear-sky index carried
forward with damping, consumption is the hourly profile, and the tariff score is a wave over the forecast steps.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwise.functions.scalars import add_hours, clear_sky_index, solar_elevation
from gridwise.operators.forecasts import SOLAR_HORIZON, consumption_history, profile_forecast, solar_energy
from gridwise.operators.series import last_row
from gridwise.operators.statistics import Scale
from gridwise.operators.tariff import HORIZON, price_forecast
from gridwise.operators.validate import priced
from gridwise.plans.consumption_model import ConsumptionModels
from gridwise.schemas import CONSUMPTION_FEATURES, SITE
from gridwise.sources import driver

DAMPING = 0.05


def solar_prediction(readings: DataFrame) -> DataFrame:
    """(site_id, step, ts, ghi) for three hours after the last reading."""
    last = last_row(readings.select(SITE, "ts", "GHI"))
    index = clear_sky_index("GHI", solar_elevation(F.hour("ts")))
    steps = last.withColumn("clear", index).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(SOLAR_HORIZON))))
    ahead = steps.withColumn("ts", add_hours("ts", F.col("step")))
    ghi = F.col("clear") * (solar_elevation(F.hour("ts")) * 10 + 1) * F.exp(F.col("step") * -DAMPING)
    return ahead.select(SITE, "step", "ts", ghi.alias("ghi"))


def solar(spark: SparkSession, folder: str) -> DataFrame:
    """For sites that own a panel."""
    panels = driver.panels(spark, folder)
    predicted = solar_prediction(driver.readings(spark, folder))
    return solar_energy(predicted.join(panels.select(SITE), SITE, "left_semi"), panels)


def consumption(spark: SparkSession, folder: str) -> DataFrame:
    return profile_forecast(consumption_history(driver.consumption(spark, folder)))


def tariff_scores(spark: SparkSession, folder: str) -> DataFrame:
    """For sites whose last conditions name an average price."""
    valid, _ = priced(driver.tariff_input(spark, folder))
    steps = valid.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))))
    raw = F.sin(F.col("step") * (F.col("demand") + 1.0) + F.col("hour")) * 2.0
    return steps.withColumn("raw", raw)


def tariff(spark: SparkSession, folder: str) -> DataFrame:
    return price_forecast(tariff_scores(spark, folder))


def all_three(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return solar(spark, folder), consumption(spark, folder), tariff(spark, folder)


class MeanOfLags:
    """A base model that SQL can repeat: the mean of the last hour and the hour a day before."""

    def transform(self, rows: DataFrame) -> DataFrame:
        # By way of the vector, as a fitted model does: it keeps the steps of the recursion apart in the plan.
        value = lambda name: vector_to_array("features")[CONSUMPTION_FEATURES.index(name)]
        return rows.withColumn("base", (value("lag_1") + value("lag_24")) / 2)


class HalfOfLastError:
    """A correction that SQL can repeat: half of the last scaled error."""

    def copy(self) -> HalfOfLastError:
        return self

    def setFeaturesCol(self, name: str) -> HalfOfLastError:
        return self

    def transform(self, state: DataFrame) -> DataFrame:
        return state.withColumn("next_error", F.element_at(vector_to_array("sequence"), -1) / 2)


def consumption_models() -> ConsumptionModels:
    return ConsumptionModels(MeanOfLags(), Scale([0.1], [2.0]), HalfOfLastError())
