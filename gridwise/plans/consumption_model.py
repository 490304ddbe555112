"""Consumption forecast with fitted models: a base model on 14 features, a correction from its last 24 errors, and a
24-step recursion in which every site is one row and each step scores all sites at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridwise.functions.arrays import append_value, left_pad_first
from gridwise.operators.consumption_features import KEEP, consumption_features, next_hour_features
from gridwise.operators.forecasts import (
    CONSUMPTION_HORIZON, consumption_history, explode_steps, floor_profile_fallback, last_value_fallback,
)
from gridwise.operators.resample import hourly_profile
from gridwise.operators.series import site_window
from gridwise.operators.statistics import Scale, fit_linear, fit_scale
from gridwise.operators.validate import fill_missing_features
from gridwise.schemas import CONSUMPTION_FEATURES, SITE
from gridwise.session import use_checkpoint_dir
from gridwise.sources.models import load_models, save_models

# Errors the correction looks at.
SEQUENCE = 24
# Recursion steps between checkpoints.
STEPS_PER_CHECKPOINT = 8
SEED = 7


@dataclass
class ConsumptionModels:
    base: Model
    # Without these two the base prediction stands alone.
    scale: Scale | None = None
    correction: Model | None = None
    sequence: int = SEQUENCE
    # Names in the order in which the base model was fitted.
    features: list[str] = field(default_factory=lambda: list(CONSUMPTION_FEATURES))

    def save(self, spark: SparkSession, folder: str) -> None:
        parts, values = {"base": self.base}, {"sequence": self.sequence, "features": self.features}
        if self.correction is not None:
            parts["correction"], values["scale"] = self.correction, asdict(self.scale)
        save_models(spark, folder, parts, values)


def load_consumption_models(spark: SparkSession, folder: str) -> ConsumptionModels:
    parts, values = load_models(spark, folder)
    scale = Scale(**values["scale"]) if "scale" in values else None
    return ConsumptionModels(parts["base"], scale, parts.get("correction"), values.get("sequence", SEQUENCE), values["features"])


def base_consumption(rows: DataFrame, base: Model, names: list[str] = CONSUMPTION_FEATURES) -> DataFrame:
    """Adds the base prediction as `base`; a feature that the rows lack is 0."""
    kept = [c for c in rows.columns if c not in CONSUMPTION_FEATURES and c not in names]
    filled = fill_missing_features(rows, names, kept)
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(filled)
    return base.transform(assembled).drop("features", *names)


def fit_consumption(features: DataFrame) -> ConsumptionModels:
    assembled = VectorAssembler(inputCols=CONSUMPTION_FEATURES, outputCol="features").transform(features)
    base = GBTRegressor(
        featuresCol="features", labelCol="kw", predictionCol="base", maxIter=8, maxDepth=4, maxBins=32, seed=SEED
    ).fit(assembled)
    return with_correction(features, base, lambda train: LinearRegression(
        featuresCol="errors", labelCol="error", predictionCol="next_error", solver="normal", regParam=0.1
    ).fit(train))


def with_correction(features: DataFrame, base: Model, fit: Callable[[DataFrame], Model]) -> ConsumptionModels:
    """The base model with a correction that is fitted on (`errors`, the scaled errors before; `error`, the next one)."""
    errors = base_consumption(features, base).select(SITE, "ts", "kw", (F.col("kw") - F.col("base")).alias("error"))
    errors = errors.persist(StorageLevel.MEMORY_AND_DISK)  # each pass of the scale reads them
    models = ConsumptionModels(base, fit_scale(errors, ["error"]))
    scaled = errors.withColumn("error", models.scale.scaled(F.col("error")))
    w = site_window(scaled)
    past = F.collect_list("error").over(w.rowsBetween(-SEQUENCE, -1))
    train = scaled.withColumn("past", past).where(F.size("past") == SEQUENCE)
    models.correction = fit(train.select("error", array_to_vector("past").alias("errors")))
    errors.unpersist()
    return models


def fit_linear_consumption(features: DataFrame, inputs: list[str]) -> ConsumptionModels:
    """The same in closed form: least squares on some features, and a line on the last error."""
    assembled = VectorAssembler(inputCols=CONSUMPTION_FEATURES, outputCol="features").transform(features)
    base = fit_linear(assembled, "features", [CONSUMPTION_FEATURES.index(c) for c in inputs], "kw", "base")
    return with_correction(features, base, lambda train: fit_linear(train, "errors", [SEQUENCE - 1], "error", "next_error"))


def residual_sequence(features: DataFrame, models: ConsumptionModels) -> DataFrame:
    """Per site: the last 48 values (`hist`), and the last 24 scaled errors of the base model (`errors`), padded on the
    left with the first one; zeros without a correction model."""
    # The window runs backwards: the row with rank 1 is the last one. Only the last rows are scored.
    rank = F.row_number().over(Window.partitionBy(SITE).orderBy(F.col("ts").desc(), F.col("kw").desc()))
    last = features.withColumn("back", rank).where(F.col("back") <= KEEP)
    scored = base_consumption(last, models.base, models.features).withColumn("error", F.col("kw") - F.col("base"))
    recent = scored.withColumn("error", models.scale.scaled(F.col("error")) if models.correction is not None else F.lit(0.0))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("k"), "kw", "error")))
    listed = recent.groupBy(SITE).agg(rows.alias("rows"), F.max("ts").alias("last_ts"))
    return listed.select(
        SITE,
        "last_ts",
        F.transform("rows", lambda r: r["kw"]).alias("hist"),
        left_pad_first(F.transform("rows", lambda r: r["error"]), models.sequence).alias("errors"),
    )


def residual_correct(models: ConsumptionModels) -> tuple[Column, Column]:
    """The base prediction plus the expected error, never below 0, and the sequence with the new scaled error."""
    base, errors = F.col("base"), F.col("errors")
    if models.correction is None:
        return base, errors
    error = F.greatest(models.scale.restored(F.col("next_error")), -base)
    return base + error, append_value(errors, F.col("next_error"), keep=models.sequence)


def recursive_24h(features: DataFrame, profiles: DataFrame, models: ConsumptionModels) -> DataFrame:
    """24 hours per site; each hour is predicted from a history that ends with the previous predictions.

    One row per site with short arrays, so a step is a projection: nothing is shuffled in the loop. The plan is cut by a
    checkpoint every few steps. Every step has the same expressions, which are built once.
    """
    use_checkpoint_dir(features.sparkSession)
    state = residual_sequence(features, models).join(profiles.select(SITE, "profile"), SITE).select(
        SITE, "last_ts", F.col("last_ts").alias("now"), "profile", "errors", "hist",
        F.array().cast("array<double>").alias("forecast"),
    )
    hist, hour = F.col("hist"), F.col("now") + F.expr("INTERVAL 1 HOUR")
    inputs = next_hour_features(hist, F.element_at(hist, 1), hour)
    # The assembler also keeps the optimizer from merging the steps into one expression, which would repeat `hist` in
    # each of the inputs and grow with a power of the steps.
    inputs |= {name: F.lit(0.0) for name in models.features if name not in inputs}
    stages = [VectorAssembler(inputCols=models.features, outputCol="features"), models.base]
    if models.correction is not None:
        stages.append(models.correction.copy().setFeaturesCol("sequence"))
        inputs["sequence"] = array_to_vector("errors")
    hybrid, errors = residual_correct(models)
    kept = F.greatest(last_value_fallback(hybrid, hist), F.lit(0.0))
    value = floor_profile_fallback(kept, F.col("profile"), F.hour(hour))
    following = [
        F.col(SITE),
        F.col("last_ts"),
        hour.alias("now"),
        F.col("profile"),
        errors.alias("errors"),
        append_value(hist, F.col("value"), keep=KEEP).alias("hist"),
        append_value(F.col("forecast"), F.col("value")).alias("forecast"),
    ]
    for step in range(1, CONSUMPTION_HORIZON + 1):
        state = state.withColumns(inputs)
        for stage in stages:
            state = stage.transform(state)
        state = state.withColumn("value", value).select(*following)
        if step % STEPS_PER_CHECKPOINT == 0 and step < CONSUMPTION_HORIZON:
            state = state.checkpoint()
    return explode_steps(state, "forecast", CONSUMPTION_HORIZON)


def consumption_24h(raw: DataFrame) -> DataFrame:
    """Fit on the histories of all sites and forecast each of them."""
    series = consumption_history(raw)
    features = consumption_features(series).persist(StorageLevel.MEMORY_AND_DISK)
    models = fit_consumption(features)
    forecast = recursive_24h(features, hourly_profile(series), models)
    features.unpersist()  # the last steps go on from a checkpoint
    return forecast
