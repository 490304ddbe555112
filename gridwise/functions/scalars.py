"""Scalar column expressions. All of them are built-in functions, so they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Irradiance bands in W/m2, upper bound excluded.
IRRADIANCE_BANDS = [(100, "Low ☁️"), (400, "Moderate 🌤️"), (700, "High 🌥️")]
IRRADIANCE_TOP = "Excellent ☀️"
# Names shown for a weekday (0 = Monday) and a month (1 = January).
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Periods of the cyclic encodings.
PERIODS = {"hour": 24, "month": 12, "dayofyear": 365, "dayofweek": 7}

LABEL_FORMAT = "yyyy-MM-dd HH:mm"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    """Hour, day, month, day of year and weekday (Monday = 0)."""
    ts = _col(ts)
    return {
        "hour": F.hour(ts),
        "day": F.dayofmonth(ts),
        "month": F.month(ts),
        "dayofyear": F.dayofyear(ts),
        "dayofweek": F.weekday(ts),
    }


def cyclic_encode(value: Column | str, period: int) -> tuple[Column, Column]:
    angle = _col(value) * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def solar_elevation(hour: Column | str) -> Column:
    """A triangle over the day, 90 degrees at noon; it is zero only at midnight."""
    return F.greatest(F.lit(90.0) - F.abs(_col(hour) - 12) * 7.5, F.lit(0.0))


def clear_sky_index(ghi: Column | str, elevation: Column | str) -> Column:
    elevation = _col(elevation)
    return F.when(elevation > 0, _col(ghi) / (elevation * 10 + 1)).otherwise(0.0)


def dni_dhi_ratio(dni: Column | str, dhi: Column | str) -> Column:
    dhi = _col(dhi)
    return F.when(dhi > 0, _col(dni) / dhi).otherwise(0.0)


def clip(value: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clip to one or two bounds. Null stays null, where greatest/least would skip it."""
    value = _col(value)
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def round_stable(value: Column | str, digits: int) -> Column:
    """Round half up. Sums differ in the last bit with the order of their rows; the shift keeps an exact tie from
    rounding up in one run and down in the next."""
    return F.round(_col(value) + 1e-9, digits)


def safe_number(value: Column | str, digits: int = 4) -> Column:
    """Null, NaN and infinity become 0; the rest is floored at 0 and rounded."""
    value = _col(value).cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, 0.0).otherwise(round_stable(F.greatest(value, F.lit(0.0)), digits))


def null_to_zero(value: Column | str) -> Column:
    value = _col(value).cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def nan_to_null(value: Column | str) -> Column:
    return F.nanvl(_col(value).cast("double"), F.lit(None).cast("double"))


def ghi_to_kwh(ghi: Column | str, area_m2: Column | str, efficiency: Column | str) -> Column:
    """Energy of one hour at this irradiance, in kWh to 4 decimals."""
    return F.greatest(round_stable(_col(ghi) * _col(area_m2) * _col(efficiency) / 1000.0, 4), F.lit(0.0))


def irradiance_category(ghi: Column | str) -> Column:
    """Band name; give it the unrounded irradiance."""
    ghi = _col(ghi)
    (bound, name), *rest = IRRADIANCE_BANDS
    out = F.when(ghi < bound, name)
    for bound, name in rest:
        out = out.when(ghi < bound, name)
    return out.otherwise(IRRADIANCE_TOP)


def add_hours(ts: Column | str, hours: Column | int) -> Column:
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return _col(ts) + F.make_dt_interval(hours=hours)


def horizon_label(ts: Column | str, hours: Column | int = 0) -> Column:
    return F.date_format(add_hours(ts, hours), LABEL_FORMAT)


def time_of_label(label: Column | str) -> Column:
    return F.split(_col(label), " ")[1]


def am_pm(hour: Column | str) -> Column:
    hour = _col(hour)
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(twelve.cast("string"), F.lit(":00 "), F.when(hour < 12, "AM").otherwise("PM"))


def hh_label(hour: Column | str) -> Column:
    return F.concat(F.lpad(_col(hour).cast("string"), 2, "0"), F.lit(":00"))


def day_name(dow: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), _col(dow).cast("int") + 1)


def month_name(month: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), _col(month).cast("int"))


def forecast_hour(start_hour: Column | str, step: Column | str) -> Column:
    """Hour of day at `step` (1-based) after the start hour."""
    return F.pmod(_col(start_hour) + _col(step), F.lit(24))


def percent_to_fraction(percent: Column | str) -> Column:
    return _col(percent) / 100.0


def tariff_band(raw: Column | str, hist_avg: Column | str, demand: Column | str) -> Column:
    """Map a raw score to a price between (0.8 - 0.1 d) and (1.2 + 0.1 d) times the average, then into 1..25."""
    hist_avg, demand = _col(hist_avg), _col(demand)
    share = F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(raw)))
    base = hist_avg * (F.lit(0.8) - demand * 0.1)
    spread = hist_avg * (F.lit(0.4) + demand * 0.2)
    return clip(base + share * spread, 1.0, 25.0)


def tariff_score(price: Column | str, hist_avg: Column | str, demand: Column | str) -> Column:
    """The raw score whose band is this price; prices outside the band take its edges (1 % inside)."""
    hist_avg, demand = _col(hist_avg), _col(demand)
    base = hist_avg * (F.lit(0.8) - demand * 0.1)
    spread = hist_avg * (F.lit(0.4) + demand * 0.2)
    share = clip((_col(price) - base) / spread, 0.01, 0.99)
    return F.log(share / (F.lit(1.0) - share))


def tariff_badge(price: Column, low: Column, high: Column, mean: Column) -> Column:
    """Peak is tested first, so flat prices are all Peak."""
    return (
        F.when(price >= mean + (high - mean) * 0.4, "Peak")
        .when(price <= mean - (mean - low) * 0.4, "Off-peak")
        .otherwise("Mid")
    )


def bar_pct(price: Column, low: Column, high: Column) -> Column:
    return ((price - low) / F.greatest(high - low, F.lit(0.01)) * 100).cast("int")


def full_time(ts: Column | str) -> Column:
    """Date and time with seconds, and with microseconds where there are any."""
    ts = _col(ts)
    whole = F.date_trunc("second", ts).cast("timestamp_ntz") == ts
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
