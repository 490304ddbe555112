"""Tariff conditions, the 24 x 14 input sequence, the price forecast and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwise.functions.scalars import (
    am_pm, bar_pct, clip, cyclic_encode, forecast_hour, hh_label, tariff_badge, tariff_band,
)
from gridwise.schemas import SITE, TARIFF_COLUMNS

# Frames, horizon and the lags of the input sequence.
FRAMES = 24
HORIZON = 12
TARIFF_LAGS = [1, 2, 3, 6, 12]
FRAME_COLUMNS = [
    "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos",
    "temperature_norm", "demand_index", "hist_avg_norm",
] + [f"tariff_lag_{k}" for k in TARIFF_LAGS]


def tariff_bounds(df: DataFrame) -> DataFrame:
    """Clip hour, weekday, month and demand; temperature and average price are taken as they are."""
    hour, dow, month, temperature, average, demand = (F.col(c).cast("double") for c in TARIFF_COLUMNS)
    return df.select(
        SITE,
        clip(hour, 0.0, 23.0).cast("int").alias("hour"),
        clip(dow, 0.0, 6.0).cast("int").alias("dow"),
        clip(month, 1.0, 12.0).cast("int").alias("month"),
        temperature.alias("temperature"),
        average.alias("hist_avg"),
        clip(demand, 0.0, 1.0).alias("demand"),
    )


def tariff_sequence(conditions: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """24 frames of 14 values per site, the last frame at the current hour.

    `prices(site_id, recent)` holds the prices up to the current hour as an array, latest (the current one) first. A lag
    that it does not reach is the average price. Values are scaled by 1/10 like the average.
    """
    if prices is None:
        joined = conditions.withColumn("recent", F.array().cast("array<double>"))
    else:
        joined = conditions.join(prices, SITE, "left")
    frames = joined.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))))
    back = F.lit(FRAMES - 1) - F.col("frame")
    frames = frames.withColumn("frame_hour", F.pmod(F.col("hour") - back, F.lit(24)))

    average = F.col("hist_avg") / 10.0
    waves: dict[str, Column] = {}
    for name, column, period in (("hour", "frame_hour", 24), ("day", "dow", 7), ("month", "month", 12)):
        waves[f"{name}_sin"], waves[f"{name}_cos"] = cyclic_encode(column, period)
    lags = {
        f"tariff_lag_{k}": F.coalesce(F.try_element_at("recent", (back + k + 1).cast("int")) / 10.0, average)
        for k in TARIFF_LAGS
    }
    columns = {
        **waves,
        "temperature_norm": (F.col("temperature") - 20.0) / 30.0,
        "demand_index": F.col("demand"),
        "hist_avg_norm": average,
        **lags,
    }
    return frames.withColumns(columns).select(SITE, "frame", "frame_hour", *FRAME_COLUMNS)


def price_forecast(scores: DataFrame) -> DataFrame:
    """Scores (site_id, hour, hist_avg, demand, step, raw) to the tariff forecast table."""
    return scores.select(
        SITE,
        "step",
        forecast_hour("hour", "step").alias("hour"),
        tariff_band("raw", "hist_avg", "demand").alias("tariff"),
    )


def argmax_first(value: str, step: str = "step") -> Column:
    """Step of the first maximum: an aggregate over (value, earlier step first)."""
    return -F.max(F.struct(F.col(value), (-F.col(step)).alias("k")))["k"]


def argmin_first(value: str, step: str = "step") -> Column:
    return F.min(F.struct(F.col(value), F.col(step).alias("k")))["k"]


def tariff_stats(forecast: DataFrame, **extra: Column) -> DataFrame:
    """Per site: lowest, highest and mean price, spread, and the steps and hours of the first extremes.

    `peak_index` and `off_peak_index` count from 0, steps from 1. `extra` aggregates are computed along.
    """
    high = F.max(F.struct("tariff", (-F.col("step")).alias("back"), "hour")).alias("high")
    low = F.min(F.struct("tariff", "step", "hour")).alias("low")
    first = F.min(F.struct("step", "tariff")).alias("next")
    return (
        forecast.groupBy(SITE)
        .agg(high, low, first, F.avg("tariff").alias("avg_tariff"), *[c.alias(name) for name, c in extra.items()])
        .select(
            SITE,
            F.col("low.tariff").alias("min_tariff"),
            F.col("high.tariff").alias("max_tariff"),
            "avg_tariff",
            (F.col("high.tariff") - F.col("low.tariff")).alias("spread"),
            (-F.col("high.back") - 1).alias("peak_index"),
            (F.col("low.step") - 1).alias("off_peak_index"),
            F.col("high.hour").alias("peak_hour"),
            F.col("low.hour").alias("cheap_hour"),
            F.col("next.tariff").alias("next_tariff"),
            *extra,
        )
    )


def tariff_badges(forecast: DataFrame) -> DataFrame:
    """Price band and bar length of every step, relative to the site's own 12 hours."""
    w = Window.partitionBy(SITE)
    low, high, mean = (f("tariff").over(w) for f in (F.min, F.max, F.avg))
    return forecast.withColumns({
        "badge": tariff_badge(F.col("tariff"), low, high, mean),
        "bar_pct": bar_pct(F.col("tariff"), low, high),
        "hour_label": am_pm("hour"),
    })


def top_k_hours(forecast: DataFrame, k: int = 3) -> DataFrame:
    """The k cheapest and the k dearest hours of each site; ties keep step order."""
    w = Window.partitionBy(SITE)
    ranked = forecast.withColumns({
        "cheap_rank": F.row_number().over(w.orderBy("tariff", "step")),
        "dear_rank": F.row_number().over(w.orderBy(F.col("tariff").desc(), "step")),
    })
    cheap = F.struct(F.lit("cheapest").alias("kind"), F.col("cheap_rank").alias("rank"))
    dear = F.struct(F.lit("dearest").alias("kind"), F.col("dear_rank").alias("rank"))
    both = F.array_compact(F.array(F.when(F.col("cheap_rank") <= k, cheap), F.when(F.col("dear_rank") <= k, dear)))
    return ranked.withColumn("pick", F.explode(both)).select(SITE, "pick.*", "step", "hour", "tariff")


def appliance_hours(forecast: DataFrame) -> DataFrame:
    """Best and worst hours for heavy loads as text, and the saving per kWh between the extremes."""
    text = F.concat(hh_label("hour"), F.format_string(" (₹%.2f)", "tariff"))
    listed = (
        top_k_hours(forecast).groupBy(SITE, "kind")
        .agg(F.sort_array(F.collect_list(F.struct("rank", text.alias("text")))).alias("rows"))
        .withColumn("text", F.concat_ws(", ", F.transform("rows", lambda r: r["text"])))
    )
    lists = listed.groupBy(SITE).agg(
        F.max(F.when(F.col("kind") == "cheapest", F.col("text"))).alias("best_hours"),
        F.max(F.when(F.col("kind") == "dearest", F.col("text"))).alias("worst_hours"),
    )
    return lists.join(tariff_stats(forecast).select(SITE, F.col("spread").alias("saving_per_kwh")), SITE)
