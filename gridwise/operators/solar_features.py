"""The 77 solar features. All row-based frames share one window per site: one exchange and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from gridwise.functions.scalars import (
    calendar_parts, clear_sky_index, cyclic_encode, dni_dhi_ratio, solar_elevation, PERIODS,
)
from gridwise.operators.scan import Averages, readings_reached
from gridwise.operators.series import ROWS_PER_BLOCK, last_n_rows, over_series
from gridwise.operators.validate import LONGEST_LAG, LOOKBACK, drop_incomplete
from gridwise.schemas import (
    DIFF_LAGS, EMA_SPANS, FEATURES, LAGGED, MODE_WIDTHS, ROLLING, SENSORS, SITE, SOLAR_LAGS,
)

AVERAGES = Averages("GHI", tuple(EMA_SPANS))
MODE_REACH = max(MODE_WIDTHS) // 2


def add_calendar(df: DataFrame) -> DataFrame:
    parts = calendar_parts("ts")
    df = df.withColumns({name: parts[name] for name in PERIODS})
    waves = {}
    for name, period in PERIODS.items():
        waves[f"{name}_sin"], waves[f"{name}_cos"] = cyclic_encode(name, period)
    return df.withColumns({**waves, "solar_elevation": solar_elevation("hour")})


def add_ratios(df: DataFrame) -> DataFrame:
    """Needs `solar_elevation`."""
    return df.withColumns({
        "clear_sky_index": clear_sky_index("GHI", "solar_elevation"),
        "DNI_DHI_ratio": dni_dhi_ratio("DNI", "DHI"),
        **interactions(),
    })


def interactions() -> dict[str, Column]:
    return {"temp_humidity": F.col("T_amb") * F.col("RH"), "wind_pressure": F.col("WS") * F.col("BP")}


def lags_null(w: WindowSpec) -> dict[str, Column]:
    return {f"{c}_lag_{k}": F.lag(c, k).over(w) for k in SOLAR_LAGS for c in LAGGED}


def diffs(w: WindowSpec) -> dict[str, Column]:
    return {f"GHI_diff_{k}": F.col("GHI") - F.lag("GHI", k).over(w) for k in DIFF_LAGS}


def rolling_stats(w: WindowSpec) -> dict[str, Column]:
    """Trailing frames including the row itself, shorter at the start. The std of one row is 0."""
    out = {}
    for k in ROLLING:
        frame = w.rowsBetween(-(k - 1), 0)
        out[f"GHI_rolling_mean_{k}"] = F.avg("GHI").over(frame)
        out[f"GHI_rolling_std_{k}"] = F.coalesce(F.stddev_samp("GHI").over(frame), F.lit(0.0))
        out[f"GHI_rolling_min_{k}"] = F.min("GHI").over(frame)
        out[f"GHI_rolling_max_{k}"] = F.max("GHI").over(frame)
    return out


def centred_means(w: WindowSpec) -> dict[str, Column]:
    """Means around each row, shorter at both ends. They look ahead, except at the last row."""
    return {
        f"VMD_mode_{i}": F.avg("GHI").over(w.rowsBetween(-(width // 2), width // 2))
        for i, width in enumerate(MODE_WIDTHS, 1)
    }


def mode_sums() -> dict[str, Column]:
    return {
        "VMD_high_freq": F.col("VMD_mode_1") + F.col("VMD_mode_2"),
        "VMD_low_freq": F.col("VMD_mode_6") + F.col("VMD_mode_7"),
    }


def ewm_mean(df: DataFrame, w: WindowSpec, column: str = "GHI", spans: list[int] = EMA_SPANS) -> DataFrame:
    """Exponential moving averages over whole sites; for sites that may be cut, give `over_series` the scan `Averages`."""
    return Averages(column, tuple(spans)).whole(df, w)


def solar_features(
    readings: DataFrame, bounded: bool = False, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """site_id, ts, GHI and the 77 features in training order, without the incomplete first rows of each site."""

    # The averages go first, while rows are narrow: each of their steps copies the row.
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumns({**lags_null(w), **diffs(w), **rolling_stats(w), **centred_means(w)})
        return add_ratios(add_calendar(df)).withColumns(mode_sums())

    wanted = readings.select(SITE, "ts", *SENSORS)
    built = over_series(wanted, build, max(LONGEST_LAG, MODE_REACH), MODE_REACH, bounded, rows_per_block, AVERAGES, deal=True)
    return drop_incomplete(built.select(SITE, "ts", "GHI", *FEATURES))


def scoring_readings(readings: DataFrame, rows: int = LOOKBACK) -> DataFrame:
    """The readings that the last `rows` feature rows of each site depend on; features of these are `bounded`.

    For complete readings: a row without irradiance would take the place of one that the averages still depend on.
    """
    reach = max(readings_reached(EMA_SPANS), LONGEST_LAG, MODE_REACH)
    return last_n_rows(readings.select(SITE, "ts", *SENSORS), rows + reach, deal=True)


def lookback_matrix(
    features: DataFrame, columns: list[str] = FEATURES, lookback: int = LOOKBACK, bounded: bool = False
) -> DataFrame:
    """The last `lookback` feature rows of each site as one array, oldest row first; shorter sites give no row."""
    return last_lookback(features.select(SITE, "ts", F.array(*columns).alias("x")), lookback, bounded)


def last_lookback(rows: DataFrame, lookback: int = LOOKBACK, bounded: bool = False) -> DataFrame:
    """`lookback_matrix` for feature rows already held in an array `x`."""
    recent = last_n_rows(rows.select(SITE, "ts", "x"), lookback, bounded)
    listed = F.sort_array(F.collect_list(F.struct("ts", "x")))
    return (
        recent.groupBy(SITE).agg(listed.alias("rows"), F.max("ts").alias("last_ts"))
        .where(F.size("rows") == lookback)
        .select(SITE, "last_ts", F.flatten(F.transform("rows", lambda r: r["x"])).alias("lookback"))
    )


def all_lookbacks(
    rows: DataFrame, horizon: int, lookback: int = LOOKBACK, bounded: bool = False, elements: list[int] | None = None
) -> DataFrame:
    """For every row with a full past and future: `lookback` and the irradiance of the next hours as `y1`, `y2`, ...

    `lookback` has the given `elements` of the whole vector only, each taken from its row, or all without them.
    """

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        ahead = {f"y{h}": F.lead("GHI", h).over(w) for h in range(1, horizon + 1)}
        if elements is None:
            past = F.flatten(F.collect_list("x").over(w.rowsBetween(-(lookback - 1), 0)))
        else:
            past = F.array(*[element(p, w) for p in elements]).cast("array<double>")
        return df.withColumns({"lookback": past, "oldest": F.lag("ts", lookback - 1).over(w), **ahead})

    def element(place: int, w: WindowSpec) -> Column:
        row, column = divmod(place, width)
        return F.lag(F.col("x")[column], lookback - 1 - row).over(w)

    width = len(FEATURES)
    built = over_series(rows.select(SITE, "ts", "GHI", "x"), build, lookback - 1, horizon, bounded)
    full = built.where(F.col("oldest").isNotNull() & F.col(f"y{horizon}").isNotNull())
    return full.select(SITE, "ts", "lookback", *[f"y{h}" for h in range(1, horizon + 1)])
