"""Table schemas and column lists."""

from __future__ import annotations

from pyspark.sql import types as T

SITE = "site_id"

# The sensor columns of a reading, in input order.
SENSORS = ["GHI", "DNI", "DHI", "T_amb", "RH", "WS", "WS_gust", "WD", "WD_std", "BP"]
# The columns of a tariff condition row.
TARIFF_COLUMNS = ["hour", "day_of_week", "month", "temperature", "historical_avg_tariff", "demand_index"]


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


LONG, INT, DOUBLE, STRING, NTZ = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType(),
)

READINGS = _table((SITE, LONG), ("ts", NTZ), *[(c, DOUBLE) for c in SENSORS])
RAW_READINGS = _table((SITE, LONG), ("datetime", STRING), *[(c, DOUBLE) for c in SENSORS])
PANELS = _table((SITE, LONG), ("area_m2", DOUBLE), ("efficiency", DOUBLE))
CONSUMPTION = _table((SITE, LONG), ("ts", NTZ), ("kw", DOUBLE))
TARIFF_INPUT = _table(
    (SITE, LONG), ("hour", INT), ("dow", INT), ("month", INT),
    ("temperature", DOUBLE), ("hist_avg", DOUBLE), ("demand", DOUBLE),
)
SOLAR_FORECAST = _table(
    (SITE, LONG), ("step", INT), ("ts", NTZ), ("ghi_wm2", DOUBLE), ("energy_kwh", DOUBLE), ("category", STRING),
)
CONSUMPTION_FORECAST = _table((SITE, LONG), ("step", INT), ("ts", NTZ), ("kwh", DOUBLE))
TARIFF_FORECAST = _table((SITE, LONG), ("step", INT), ("hour", INT), ("tariff", DOUBLE))

# Lags, windows and spans of the solar features.
SOLAR_LAGS = [1, 2, 3, 6, 12, 24]
LAGGED = ["GHI", "DNI", "DHI", "T_amb"]
DIFF_LAGS = [1, 3, 6]
ROLLING = [3, 6, 12, 24]
ROLLING_STATS = ["mean", "std", "min", "max"]
EMA_SPANS = [3, 6, 12]
MODE_WIDTHS = [3, 5, 9, 17, 33, 65, 129]

CALENDAR = ["hour", "month", "dayofyear", "dayofweek"]
CYCLIC = [f"{part}_{fn}" for part in CALENDAR for fn in ("sin", "cos")]
LAG_FEATURES = [f"{c}_lag_{k}" for k in SOLAR_LAGS for c in LAGGED]
DIFF_FEATURES = [f"GHI_diff_{k}" for k in DIFF_LAGS]
ROLLING_FEATURES = [f"GHI_rolling_{s}_{k}" for k in ROLLING for s in ROLLING_STATS]
EMA_FEATURES = [f"GHI_ema_{s}" for s in EMA_SPANS]
MODE_FEATURES = [f"VMD_mode_{i}" for i in range(1, len(MODE_WIDTHS) + 1)]

# The 77 model inputs in training order. GHI itself is not one of them.
FEATURES = (
    SENSORS[1:]
    + CYCLIC
    + ["solar_elevation", "clear_sky_index", "DNI_DHI_ratio", "temp_humidity", "wind_pressure"]
    + LAG_FEATURES
    + DIFF_FEATURES
    + ROLLING_FEATURES
    + EMA_FEATURES
    + MODE_FEATURES
    + ["VMD_high_freq", "VMD_low_freq"]
)

# The inputs of the consumption model.
CONSUMPTION_LAGS = [1, 2, 3, 6, 12, 24, 48]
CONSUMPTION_FEATURES = (
    ["hour", "day", "month", "weekday"]
    + [f"lag_{k}" for k in CONSUMPTION_LAGS]
    + ["rolling_mean_6", "rolling_mean_24", "rolling_std_24"]
)
