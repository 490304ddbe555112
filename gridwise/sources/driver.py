"""The benchmark tables as energy tables.

Every event is a reading of the household `user_id`; customers own the panels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwise.functions.scalars import percent_to_fraction
from gridwise.operators.series import last_row
from gridwise.operators.tariff import tariff_bounds
from gridwise.schemas import SITE

FEEDERS = 10


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def readings(spark: SparkSession, folder: str, missing: str | None = None) -> DataFrame:
    """Readings of all households; those of the kind `missing` lack their irradiance."""
    value, event = F.col("value"), F.col("event_id")
    return table(spark, folder, "events").select(
        F.col("user_id").alias(SITE),
        "ts",
        (F.when(F.col("event_type") != missing, value * 5) if missing else value * 5).alias("GHI"),
        (value * 3.5).alias("DNI"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(value * 1.25).alias("DHI"),
        (event % 20 + 15).cast("double").alias("T_amb"),
        (event % 60 + 30).cast("double").alias("RH"),
        (event % 7 + 1).cast("double").alias("WS"),
        ((event % 7 + 1) * 1.5).cast("double").alias("WS_gust"),
        (event % 360).cast("double").alias("WD"),
        (event % 10 + 10).cast("double").alias("WD_std"),
        (event % 25 + 1000).cast("double").alias("BP"),
    )


def consumption(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias(SITE), "ts", (F.col("value") / 25).alias("kw"))


def feeder_consumption(spark: SparkSession, folder: str) -> DataFrame:
    """The same readings by feeder: ten groups of households, so few and long series with many rows per hour."""
    return consumption(spark, folder).withColumn(SITE, F.col(SITE) % FEEDERS)


def tariff_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a tariff condition row with time, before bounds. A household in error reports no average price."""
    value, event = F.col("value"), F.col("event_id")
    return table(spark, folder, "events").select(
        F.col("user_id").alias(SITE),
        "ts",
        F.hour("ts").alias("hour"),
        F.weekday("ts").alias("day_of_week"),
        F.month("ts").alias("month"),
        (value % 40).alias("temperature"),
        F.when(F.col("event_type") != "error", value % 19 + 1).alias("historical_avg_tariff"),
        ((event % 11) / 10).alias("demand_index"),
    )


def tariff_input(spark: SparkSession, folder: str) -> DataFrame:
    return tariff_bounds(last_row(tariff_conditions(spark, folder)))


def panels(spark: SparkSession, folder: str) -> DataFrame:
    """Panels of the customers outside one market segment; another segment has no known efficiency."""
    percent = (F.col("c_custkey") % 10 + 15).cast("double")
    owners = table(spark, folder, "customer").where(F.col("c_mktsegment") != "FURNITURE")
    return owners.select(
        F.col("c_custkey").cast("long").alias(SITE),
        (F.col("c_nationkey") + 5).cast("double").alias("area_m2"),
        F.when(F.col("c_mktsegment") != "MACHINERY", percent_to_fraction(percent)).alias("efficiency"),
    )
