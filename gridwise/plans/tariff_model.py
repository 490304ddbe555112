"""Tariff forecast with a fitted model: one score per site and step, mapped to the price band."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, WindowSpec, functions as F

from gridwise.functions.scalars import cyclic_encode, forecast_hour, tariff_score
from gridwise.operators.series import last_n_rows, last_row, over_series
from gridwise.operators.statistics import Linear, fit_linear
from gridwise.operators.tariff import (
    FRAME_COLUMNS, FRAMES, HORIZON, TARIFF_LAGS, price_forecast, tariff_bounds, tariff_sequence,
)
from gridwise.operators.validate import priced
from gridwise.schemas import SITE

# One current price and the reach of the longest lag of the first frame.
RECENT = FRAMES + max(TARIFF_LAGS)
INPUTS = [*FRAME_COLUMNS, "step", "ahead_sin", "ahead_cos"]


def training_rows(conditions: DataFrame) -> DataFrame:
    """One row per past condition and step: the frame at that time and the score of the price that followed."""
    bounded = conditions.where("historical_avg_tariff IS NOT NULL")
    rows = bounded.select(
        SITE, "ts", "hour", F.col("day_of_week").alias("dow"), "month", "temperature",
        F.col("historical_avg_tariff").alias("hist_avg"), F.col("demand_index").alias("demand"),
    )

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        scale = F.col("hist_avg") / 10.0
        lags = {f"tariff_lag_{k}": F.coalesce(F.lag("hist_avg", k).over(w) / 10.0, scale) for k in TARIFF_LAGS}
        ahead = F.array(*[F.lead("hist_avg", k).over(w) for k in range(1, HORIZON + 1)])
        return df.withColumns({**lags, "ahead": ahead})

    built = over_series(rows, build, before=max(TARIFF_LAGS), after=HORIZON)
    waves = {}
    for name, column, period in (("hour", "hour", 24), ("day", "dow", 7), ("month", "month", 12)):
        waves[f"{name}_sin"], waves[f"{name}_cos"] = cyclic_encode(column, period)
    built = built.withColumns({
        **waves,
        "temperature_norm": (F.col("temperature") - 20.0) / 30.0,
        "demand_index": F.col("demand"),
        "hist_avg_norm": F.col("hist_avg") / 10.0,
    })
    steps = built.select("*", F.posexplode("ahead").alias("pos", "price")).where("price IS NOT NULL")
    steps = steps.withColumn("step", (F.col("pos") + 1).cast("int"))
    return with_step(steps).withColumn("label", tariff_score("price", "hist_avg", "demand"))


def with_step(df: DataFrame) -> DataFrame:
    sin, cos = cyclic_encode(forecast_hour("hour", "step"), 24)
    return df.withColumns({"ahead_sin": sin, "ahead_cos": cos})


def fit_tariff(conditions: DataFrame) -> Model:
    """A ridge regression solved from one pass of sums, so the twelvefold rows are never stored."""
    train = VectorAssembler(inputCols=INPUTS, outputCol="inputs").transform(training_rows(conditions))
    return LinearRegression(
        featuresCol="inputs", labelCol="label", predictionCol="raw", solver="normal", regParam=0.01, elasticNetParam=0.0
    ).fit(train)


def fit_linear_tariff(conditions: DataFrame, inputs: list[str]) -> Linear:
    """The same in closed form: least squares on some of the inputs."""
    train = VectorAssembler(inputCols=INPUTS, outputCol="inputs").transform(training_rows(conditions))
    return fit_linear(train, "inputs", [INPUTS.index(c) for c in inputs], "label", "raw")


def recent_prices(conditions: DataFrame) -> DataFrame:
    """The last prices of each site, latest first: what the lags of the 24 frames can reach."""
    prices = conditions.where("historical_avg_tariff IS NOT NULL").select(SITE, "ts", "historical_avg_tariff")
    last = last_n_rows(prices, RECENT)
    listed = F.sort_array(F.collect_list(F.struct("ts", "historical_avg_tariff")), asc=False)
    return last.groupBy(SITE).agg(listed.alias("rows")).select(
        SITE, F.transform("rows", lambda r: r["historical_avg_tariff"]).alias("recent")
    )


def tariff_scores(current: DataFrame, prices: DataFrame, model: Model) -> DataFrame:
    """Score of each of the next 12 hours from the last frame of the input sequence."""
    frame = tariff_sequence(current, prices).where(F.col("frame") == FRAMES - 1)
    joined = frame.join(current.select(SITE, "hour", "hist_avg", "demand"), SITE)
    steps = with_step(joined.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(HORIZON)))))
    scored = model.transform(VectorAssembler(inputCols=INPUTS, outputCol="inputs").transform(steps))
    return scored.select(SITE, "hour", "hist_avg", "demand", "step", "raw")


def tariff_12h(conditions: DataFrame, fit: Callable[[DataFrame], Model] = fit_tariff) -> DataFrame:
    """Fit on all past conditions and forecast every site whose latest ones name an average price."""
    current, _ = priced(tariff_bounds(last_row(conditions)))
    return price_forecast(tariff_scores(current, recent_prices(conditions), fit(conditions)))
