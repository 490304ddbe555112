"""Row checks: headers, times, minimum lengths, value ranges, missing features and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridwise.functions.scalars import clip, nan_to_null
from gridwise.schemas import FEATURES, SENSORS, SITE

# Smallest series each forecast accepts. 24 of the 36 readings are lost to the longest lag.
LOOKBACK = 12
LONGEST_LAG = 24
MIN_READINGS_EFFECTIVE = LONGEST_LAG + LOOKBACK
MIN_CONSUMPTION = 24

# Accepted ranges (inclusive) by column.
SENSOR_RANGES = {
    "GHI": (0.0, 1500.0), "DNI": (0.0, 1200.0), "DHI": (0.0, 600.0), "T_amb": (-20.0, 60.0), "RH": (0.0, 100.0),
    "WS": (0.0, 50.0), "WS_gust": (0.0, 80.0), "WD": (0.0, 360.0), "WD_std": (0.0, 180.0), "BP": (800.0, 1100.0),
}
CONSUMPTION_RANGES = {"kw": (0.0, 10.0)}
TARIFF_RANGES = {
    "hour": (0.0, 23.0), "dow": (0.0, 6.0), "month": (1.0, 12.0),
    "temperature": (-10.0, 50.0), "hist_avg": (1.0, 20.0), "demand": (0.0, 1.0),
}
PANEL_RANGES = {"area_m2": (0.1, 10000.0), "efficiency": (0.05, 0.35)}
SETTING_RANGES = {"shared_temp": (-10.0, 55.0), "max_rows": (1.0, 10000.0)}

# What a missing parameter becomes.
PANEL_DEFAULTS = {"area_m2": 10.0, "efficiency": 0.20}
SHARED_TEMP_DEFAULT = 28.0
TARIFF_DEFAULTS = {"hist_avg": 6.5, "demand": 0.5}


def parse_ts_drop_bad(df: DataFrame, column: str = "datetime") -> DataFrame:
    """Parse a text time column into `ts` and drop rows where that fails."""
    ts = F.try_to_timestamp(F.col(column)).cast("timestamp_ntz")
    return df.withColumn("ts", ts).drop(column).where("ts IS NOT NULL")


def row_counts(df: DataFrame) -> DataFrame:
    """Rows of each site: site_id, n."""
    return df.groupBy(SITE).agg(F.count("*").alias("n"))


def min_rows(df: DataFrame, least: int, reason: str = "too few rows") -> tuple[DataFrame, DataFrame]:
    """Rows of the sites with at least `least` rows, and the sites that were rejected (site_id, n, reason).

    The count is an aggregate joined back, not a window, so a site of any length is counted in parts.
    """
    counts = row_counts(df)
    accepted = df.join(counts.where(F.col("n") >= least), SITE, "left_semi")
    rejected = counts.where(F.col("n") < least).withColumn("reason", F.lit(reason))
    return accepted, rejected


def drop_incomplete(features: DataFrame) -> DataFrame:
    """Drop rows with a null in any feature: the first 24 rows of a site."""
    return features.dropna(subset=FEATURES)


def require_complete(readings: DataFrame) -> DataFrame:
    """Readings with all sensors present; NaN counts as missing."""
    return readings.withColumns({c: nan_to_null(c) for c in SENSORS}).dropna(subset=["ts", *SENSORS])


def missing_sensor() -> Column:
    """Whether a reading lacks its time or a sensor."""
    lacking = F.col("ts").isNull()
    for c in SENSORS:
        lacking = lacking | nan_to_null(c).isNull()
    return lacking


def failed_rules(ranges: dict[str, tuple[float, float]]) -> Column:
    """Names of the columns that are missing or out of range, in rule order."""
    checks = [
        F.when(F.coalesce(F.col(c).between(low, high), F.lit(False)), F.lit(None)).otherwise(F.lit(c))
        for c, (low, high) in ranges.items()
    ]
    return F.array_compact(F.array(*checks))


def range_checks(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all ranges, and the others with `failed` naming the columns."""
    checked = df.withColumn("failed", failed_rules(ranges))
    return checked.where(F.size("failed") == 0).drop("failed"), checked.where(F.size("failed") > 0)


def priced(conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conditions with an average price, and the sites without one (site_id, n, reason).

    TARIFF_RANGES are the limits of manual input; conditions from tables are clipped and taken as they are.
    """
    known = F.col("hist_avg").isNotNull()
    rejected = conditions.where(~known).groupBy(SITE).agg(F.count("*").alias("n"))
    return conditions.where(known), rejected.withColumn("reason", F.lit("no average price"))


def fill_missing_features(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Absent feature columns and nulls become 0; the columns come out in the given order."""
    have = set(df.columns)
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in names]
    return df.select(*keep, *filled)


def default_panels(sites: DataFrame, panels: DataFrame) -> DataFrame:
    """Panel area and efficiency of every site, with defaults where the site has none."""
    joined = sites.join(panels, SITE, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in PANEL_DEFAULTS.items()})


def default_tariff_input(sites: DataFrame, settings: DataFrame) -> DataFrame:
    """Tariff conditions from shared settings (`shared_ts`, `shared_temp`, and optionally the rest) with defaults.

    The hour comes from the shared time and the temperature is the shared one within its range, rounded to whole degrees.
    """
    have = set(settings.columns)
    joined = sites.join(settings, SITE, "left")
    temp = F.bround(clip(F.coalesce("shared_temp", F.lit(SHARED_TEMP_DEFAULT)), *SETTING_RANGES["shared_temp"]), 0)
    wanted = {
        "hour": F.hour("shared_ts"), "dow": F.weekday("shared_ts"), "month": F.month("shared_ts"), "temperature": temp,
    }
    columns = [F.coalesce(F.col(c), v).alias(c) if c in have else v.alias(c) for c, v in wanted.items()]
    columns += [
        F.coalesce(F.col(c), F.lit(v)).alias(c) if c in have else F.lit(v).alias(c) for c, v in TARIFF_DEFAULTS.items()
    ]
    return joined.select(SITE, *columns)
