"""The 14 consumption features, as a table over history and as expressions over a history array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F, Window

from gridwise.functions.arrays import mean_of, neg_index, std_pop_of, tail
from gridwise.functions.scalars import calendar_parts, null_to_zero
from gridwise.operators.series import site_window
from gridwise.operators.validate import fill_missing_features
from gridwise.schemas import CONSUMPTION_FEATURES, CONSUMPTION_LAGS, SITE
from gridwise.sources.columns import match_target_column

# The longest lag; no feature looks further back.
KEEP = max(CONSUMPTION_LAGS)


def lags_first_default(w: WindowSpec) -> dict[str, Column]:
    """Before the start of the series a lag is the first value."""
    first = F.first("kw").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return {f"lag_{k}": F.coalesce(F.lag("kw", k).over(w), first) for k in CONSUMPTION_LAGS}


def shifted_rolling(w: WindowSpec) -> dict[str, Column]:
    """Mean and sample std over past rows only.

    The first row has no past: its means are filled from the second row, whose only past value is the first one. A
    single row has nothing to fill from and gets 0.
    """
    at_start = F.when(F.lead("kw", 1).over(w).isNull(), 0.0).otherwise(F.col("kw"))
    mean = {
        f"rolling_mean_{k}": F.coalesce(F.avg("kw").over(w.rowsBetween(-k, -1)), at_start) for k in (6, 24)
    }
    std = F.coalesce(F.stddev_samp("kw").over(w.rowsBetween(-24, -1)), F.lit(0.0))
    return {**mean, "rolling_std_24": std}


def calendar_columns(ts: Column) -> dict[str, Column]:
    parts = calendar_parts(ts)
    return {"hour": parts["hour"], "day": parts["day"], "month": parts["month"], "weekday": parts["dayofweek"]}


def consumption_features(series: DataFrame, names: list[str] = CONSUMPTION_FEATURES) -> DataFrame:
    """site_id, ts, kw and the features in the given order.

    Expects the series after the resampling rule: at most 1.5 rows per hour and site, which bounds each window. The values
    are those of the column whose name says power or consumption, or else of the first one.
    """
    value = match_target_column(series.drop(SITE, "ts"))
    series = series.select(SITE, "ts", null_to_zero(value).alias("kw"))
    w = site_window(series)
    built = series.withColumns({**lags_first_default(w), **shifted_rolling(w), **calendar_columns(F.col("ts"))})
    return fill_missing_features(built, names, keep=[SITE, "ts", "kw"])


def next_hour_features(hist: Column, first: Column, ts: Column) -> dict[str, Column]:
    """Features of the hour `ts` that follows the history array. The std here is the population one.

    `first` is the first value of the whole history, which stands in for lags before its start. `hist` needs to hold
    only the last 48 values.
    """
    out = {name: value.cast("double") for name, value in calendar_columns(ts).items()}
    for k in CONSUMPTION_LAGS:
        out[f"lag_{k}"] = neg_index(hist, k, first)
    out["rolling_mean_6"] = mean_of(tail(hist, 6))
    out["rolling_mean_24"] = mean_of(tail(hist, 24))
    out["rolling_std_24"] = std_pop_of(tail(hist, 24))
    return out
