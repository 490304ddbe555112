"""Forecast tables that need no fitted model, and the post-processing shared with the fitted ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwise.functions.arrays import pad_to
from gridwise.functions.scalars import (
    add_hours, full_time, ghi_to_kwh, horizon_label, irradiance_category, round_stable, safe_number,
)
from gridwise.operators.resample import (
    PROFILE_FLOOR, hourly_profile, hourly_series, hourly_series_of_tail, profile_lookup,
)
from gridwise.operators.series import last_n_rows
from gridwise.operators.validate import LOOKBACK, MIN_CONSUMPTION, SETTING_RANGES, default_panels, min_rows
from gridwise.schemas import SITE

# Rows of a site that one request of the service looks at, and the horizons in hours.
REQUEST_ROWS = 2000
CONSUMPTION_HORIZON = 24
SOLAR_HORIZON = 3


def consumption_history(raw: DataFrame, last: int | None = None) -> DataFrame:
    """Sites with enough rows, resampled to hours where they are denser than that.

    All rows count; `last` asks for the last rows of each site only, as one request does: at least the minimum that a forecast
    needs, and no more than a request may ask for.
    """
    rows = raw.select(SITE, "ts", "kw")
    if last is None:
        return hourly_series(rows, MIN_CONSUMPTION)
    most = int(SETTING_RANGES["max_rows"][1])
    if not MIN_CONSUMPTION <= last <= most:
        raise ValueError(f"a forecast looks at {MIN_CONSUMPTION} to {most} rows")
    recent = last_n_rows(rows, last)
    # The cut keeps more rows than the minimum, so counting after it accepts the same sites without a join.
    n = F.count("*").over(Window.partitionBy(SITE))
    accepted = recent.withColumn("n", n).where(F.col("n") >= MIN_CONSUMPTION).drop("n")
    return hourly_series_of_tail(accepted)


def consumption_rejected(raw: DataFrame) -> DataFrame:
    """Sites without a consumption forecast: site_id, n, reason."""
    return min_rows(raw.select(SITE, "ts", "kw"), MIN_CONSUMPTION)[1]


def floor_profile_fallback(prediction: Column, profile: Column, hour: Column) -> Column:
    """Predictions at the floor are replaced by the site's mean for that hour of day."""
    raw = F.greatest(prediction, F.lit(PROFILE_FLOOR))
    return F.when(raw <= PROFILE_FLOOR, profile_lookup(profile, hour)).otherwise(raw)


def last_value_fallback(prediction: Column, hist: Column) -> Column:
    """A prediction that failed (null or NaN) becomes the last history value."""
    return F.coalesce(F.nanvl(prediction, F.lit(None).cast("double")), F.element_at(hist, -1))


def explode_steps(per_site: DataFrame, values: str, horizon: int, name: str = "kwh") -> DataFrame:
    """One row per step from an array per site and the time it starts after (`last_ts`)."""
    padded = per_site.withColumn(values, pad_to(F.col(values), horizon))
    rows = padded.select(SITE, "last_ts", F.posexplode(values).alias("pos", "value"))
    step = (F.col("pos") + 1).cast("int")
    return rows.select(SITE, step.alias("step"), add_hours("last_ts", step).alias("ts"), safe_number("value").alias(name))


def profile_forecast(series: DataFrame) -> DataFrame:
    """24 hours per site from its hourly profile: what the recursion gives when the model stays at the floor."""
    profiles = hourly_profile(series)
    steps = F.sequence(F.lit(1), F.lit(CONSUMPTION_HORIZON))
    hour = F.hour("last_ts")
    forecast = F.transform(
        steps,
        lambda s: floor_profile_fallback(F.lit(0.0), F.col("profile"), F.pmod(hour + s, F.lit(24))),
    )
    return explode_steps(profiles.withColumn("forecast", forecast), "forecast", CONSUMPTION_HORIZON)


def consumption_total(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy(SITE).agg(safe_number(F.sum("kwh")).alias("total_kwh"))


def solar_energy(predicted: DataFrame, panels: DataFrame) -> DataFrame:
    """Predicted irradiance (site_id, step, ts, ghi) to the solar forecast table, with default panels."""
    ghi = F.greatest(F.col("ghi"), F.lit(0.0))
    return default_panels(predicted, panels).select(
        SITE,
        "step",
        "ts",
        round_stable(ghi, 2).alias("ghi_wm2"),
        ghi_to_kwh(ghi, "area_m2", "efficiency").alias("energy_kwh"),
        irradiance_category(ghi).alias("category"),
    )


def solar_totals(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy(SITE).agg(
        round_stable(F.sum("energy_kwh"), 4).alias("total_kwh"),
        F.avg("ghi_wm2").alias("avg_ghi"),
        F.max("ghi_wm2").alias("max_ghi"),
        F.avg("energy_kwh").alias("avg_kwh"),
    )


def _response(forecast: DataFrame, row: list[Column], total: Column) -> DataFrame:
    """One row per site: `forecasts`, an array in step order (at most 24), the total and the time before the first step."""
    before = F.min(F.struct("step", "ts")).alias("first")
    grouped = forecast.groupBy(SITE).agg(F.sort_array(F.collect_list(F.struct("step", *row))).alias("forecasts"), total, before)
    last = F.col("first.ts") - F.expr("first.step * INTERVAL '1' HOUR")
    return grouped.withColumn("last_timestamp", full_time(last)).drop("first")


def solar_response(forecast: DataFrame, panels: DataFrame) -> DataFrame:
    """What a request for a solar forecast is answered with: window, forecasts, total, last time and the panel it holds for."""
    row = [horizon_label("ts").alias("hour_label"), F.col("ghi_wm2"), F.col("energy_kwh"), F.col("category").alias("irradiance_category")]
    answered = _response(forecast, row, round_stable(F.sum("energy_kwh"), 4).alias("total_energy_kwh"))
    return default_panels(answered, panels).select(
        SITE, F.lit(f"({LOOKBACK},{SOLAR_HORIZON})").alias("window"), "forecasts", "total_energy_kwh", "last_timestamp",
        F.col("area_m2").alias("panel_area_m2"), F.col("efficiency").alias("panel_efficiency"),
    )


def consumption_response(forecast: DataFrame) -> DataFrame:
    """What a request for a consumption forecast is answered with: forecasts, total and last time."""
    row = [horizon_label("ts").alias("hour_label"), F.col("kwh").alias("consumption_kwh")]
    answered = _response(forecast, row, safe_number(F.sum("kwh")).alias("total_consumption_kwh"))
    return answered.select(SITE, "forecasts", "total_consumption_kwh", "last_timestamp")


def holdout_errors(
    hourly: DataFrame, forecast: Callable[[DataFrame], DataFrame], hours: int = CONSUMPTION_HORIZON
) -> DataFrame:
    """How far a forecast of each site's last `hours` is off, next to two simple ones, in mean absolute error.

    `hourly` has one row per site and hour. The forecast sees what comes before; `error_last` repeats the last value before,
    `error_yesterday` the value a day earlier. Only hours for which all three are known count; sites without any give no row.
    """
    window = Window.partitionBy(SITE)
    split = hourly.select(SITE, "ts", "kw").withColumn("cut", F.max("ts").over(window) - F.expr(f"INTERVAL '{hours}' HOUR"))
    past, held = split.where("ts <= cut").drop("cut"), split.where("ts > cut").drop("cut")
    last = past.groupBy(SITE).agg(F.max_by("kw", "ts").alias("last"))
    day_before = past.select(SITE, (F.col("ts") + F.expr("INTERVAL '1' DAY")).alias("ts"), F.col("kw").alias("yesterday"))
    joined = held.join(forecast(past).select(SITE, "ts", "kwh"), [SITE, "ts"]).join(day_before, [SITE, "ts"]).join(last, SITE)
    known = joined.dropna(subset=["kw", "kwh", "yesterday", "last"])
    off = {"error": "kwh", "error_last": "last", "error_yesterday": "yesterday"}
    return known.groupBy(SITE).agg(F.count("*").alias("hours"), *[F.avg(F.abs(F.col("kw") - F.col(c))).alias(n) for n, c in off.items()])
