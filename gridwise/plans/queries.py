"""Registered queries: (spark, folder) -> DataFrame over the whole benchmark tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridwise.functions import arrays, scalars
from gridwise.operators import decisions, forecasts, resample, series, solar_features as sf, tariff as tf, validate
from gridwise.operators.consumption_features import consumption_features
from gridwise.operators.scan import Averages, LastKnown
from gridwise.plans import standins
from gridwise.plans.consumption_model import consumption_24h, fit_linear_consumption, recursive_24h, residual_sequence
from gridwise.plans.solar_model import (
    WIDTH, element_ranks, fit_linear_solar, fit_scales, last_chosen, place, scale_features, solar_3h, solar_direct_3h, solar_rejected,
)
from gridwise.plans.tariff_model import fit_linear_tariff, tariff_12h, training_rows
from gridwise.schemas import CYCLIC, EMA_FEATURES, FEATURES, SENSORS, SITE
from gridwise.session import shared_folder, use_checkpoint_dir
from gridwise.sources import columns, driver, readers, writers

Query = Callable[[SparkSession, str], DataFrame]


def tidy(c: Column | str) -> Column:
    """Six decimals for the comparison with SQL. The shift keeps exact ties from depending on the last bit."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + 1e-9, 6) + 0.0


def shown(df: DataFrame) -> DataFrame:
    """All doubles tidied, counts and steps as they are."""
    return df.select(*[tidy(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def solar_calendar(spark: SparkSession, folder: str) -> DataFrame:
    df = sf.add_calendar(driver.readings(spark, folder))
    return shown(df.select(SITE, "ts", "hour", "month", "dayofyear", "dayofweek", *CYCLIC, "solar_elevation"))


def solar_ratios(spark: SparkSession, folder: str) -> DataFrame:
    df = sf.add_ratios(sf.add_calendar(driver.readings(spark, folder)))
    return shown(df.select(SITE, "ts", "clear_sky_index", "DNI_DHI_ratio", "temp_humidity", "wind_pressure"))


def _windowed(spark: SparkSession, folder: str, build: Callable, before: int, after: int = 0) -> DataFrame:
    return series.over_series(driver.readings(spark, folder).select(SITE, "ts", *SENSORS), build, before, after)


def solar_lags(spark: SparkSession, folder: str) -> DataFrame:
    df = _windowed(spark, folder, lambda d, w: d.withColumns({**sf.lags_null(w), **sf.diffs(w)}), before=24)
    return shown(df.drop(*SENSORS))


def solar_rolling(spark: SparkSession, folder: str) -> DataFrame:
    df = _windowed(spark, folder, lambda d, w: d.withColumns(sf.rolling_stats(w)), before=23)
    return shown(df.drop(*SENSORS))


def solar_ewm(spark: SparkSession, folder: str) -> DataFrame:
    readings = driver.readings(spark, folder).select(SITE, "ts", *SENSORS)
    return shown(series.scanned(readings, sf.AVERAGES).select(SITE, "ts", *EMA_FEATURES))


def solar_ewm_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Averages over readings of which those of one kind are missing."""
    averages = Averages("GHI", (3, 12, 48))
    readings = driver.readings(spark, folder, missing="signup").select(SITE, "ts", "GHI")
    return shown(series.scanned(readings, averages).select(SITE, "ts", *map(averages.name, averages.spans)))


def _long_with_outages(spark: SparkSession, folder: str) -> DataFrame:
    """Ten long series whose irradiance is missing in one kind of reading and in twelve days of each month."""
    readings = driver.readings(spark, folder, missing="signup").withColumn(SITE, F.col(SITE) % 10).select(SITE, "ts", "GHI", "DNI")
    return readings.withColumn("GHI", F.when(~F.dayofmonth("ts").between(8, 19), F.col("GHI")))


def long_site_averages(spark: SparkSession, folder: str) -> DataFrame:
    """Averages of long series cut into blocks of 100 rows, with outages that are longer than a block."""
    averages = Averages("GHI", (3, 12, 48))
    df = series.scanned(_long_with_outages(spark, folder), averages, rows_per_block=100)
    return shown(df.select(SITE, "ts", "DNI", *map(averages.name, averages.spans)))


def long_site_filled(spark: SparkSession, folder: str) -> DataFrame:
    """The same series, blocks and outages with missing irradiance filled forward, and backward at a series' start."""
    return shown(series.scanned(_long_with_outages(spark, folder), LastKnown("GHI"), rows_per_block=100))


def long_site_features(spark: SparkSession, folder: str) -> DataFrame:
    """The features of ten long series, cut into blocks of 600 rows."""
    readings = driver.readings(spark, folder).withColumn(SITE, F.col(SITE) % 10)
    return shown(sf.solar_features(readings, rows_per_block=600))


def solar_modes(spark: SparkSession, folder: str) -> DataFrame:
    reach = sf.MODE_REACH
    df = _windowed(spark, folder, lambda d, w: d.withColumns(sf.centred_means(w)), before=reach, after=reach)
    return shown(df.withColumns(sf.mode_sums()).drop(*SENSORS))


def solar_features(spark: SparkSession, folder: str) -> DataFrame:
    return shown(sf.solar_features(driver.readings(spark, folder)))


def solar_lookback(spark: SparkSession, folder: str) -> DataFrame:
    """One row per element of each site's lookback vector."""
    recent = sf.scoring_readings(driver.readings(spark, folder))
    vectors = sf.lookback_matrix(sf.solar_features(recent, bounded=True), bounded=True)
    return shown(vectors.select(SITE, "last_ts", F.posexplode("lookback").alias("pos", "x")))


def solar_min_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Length check at the effective minimum per site and at twice that: rows kept, or the reason of the rejection."""
    readings = validate.require_complete(columns.require_columns(driver.readings(spark, folder), ["ts", *SENSORS]))
    leasts = F.array(*[F.lit(k * validate.MIN_READINGS_EFFECTIVE) for k in (1, 2)])
    counts = validate.row_counts(readings.select(SITE)).withColumn("least", F.explode(leasts))
    reason = F.when(F.col("n") >= F.col("least"), "ok").otherwise("too few rows")
    return counts.select(SITE, "n", reason.alias("reason"), "least")


def sensor_range_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading with its panel (or the defaults): failed rules and clipped irradiance."""
    joined = validate.default_panels(driver.readings(spark, folder), driver.panels(spark, folder))
    rules = {**validate.SENSOR_RANGES, **validate.PANEL_RANGES}
    return shown(joined.select(
        SITE,
        "ts",
        F.concat_ws(",", validate.failed_rules(rules)).alias("failed"),
        scalars.clip("GHI", *validate.SENSOR_RANGES["GHI"]).alias("ghi_clipped"),
        "area_m2",
        "efficiency",
    ))


def ingest_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as CSV lines with an untidy header and some unreadable times, then read back and resolved."""
    events = driver.table(spark, folder, "events")
    time = F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    line = F.concat_ws(",", time, F.col("value").cast("string"), F.col("event_type"))
    parsed = events.select(
        F.col("user_id").alias(SITE),
        F.from_csv(line, "` DT` STRING, `Global Active Power ` DOUBLE, `Note` STRING").alias("row"),
    ).select(SITE, "row.*")
    resolved = columns.resolve_columns(columns.normalise_header(parsed))
    return shown(resolved)


def ingest_json(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as solar requests in JSON, then parsed: typed sensors, times without seconds, bad times dropped."""
    readings = driver.readings(spark, folder)
    events = readings.withColumn(
        "datetime", F.when(F.col("DHI") == 0, "unknown").otherwise(F.date_format("ts", scalars.LABEL_FORMAT))
    )
    request = F.to_json(F.struct(F.array(F.struct("datetime", *SENSORS)).alias("historical_data")))
    parsed = events.select(SITE, F.from_json(request, readers.SOLAR_REQUEST).alias("r"))
    rows = parsed.select(SITE, F.explode("r.historical_data").alias("row")).select(SITE, "row.*")
    return shown(readers.solar_rows(rows))


def ingest_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Solar requests whose histories overlap and whose panels change: the newest of each site and time, next to its panel.

    Every fifth reading of a site sends a request with the last ten; later requests report one percent more irradiance.
    """
    w = Window.partitionBy(SITE).orderBy("ts")
    numbered = driver.readings(spark, folder).withColumns({"no": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(SITE))})
    sent = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.col("no") + i), lambda k: (k % 5 == 0) & (k <= F.col("n")))
    rows = numbered.withColumn("request", F.explode(sent)).withColumn("GHI", F.col("GHI") * (1 + F.col("request") / 100))
    row = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("datetime"), *SENSORS)
    grouped = rows.groupBy(SITE, "request").agg(F.collect_list(row).alias("historical_data"))
    request = F.to_json(F.struct(
        SITE, "historical_data", F.col("request").cast("double").alias("panel_area_m2"),
        (F.col("request") % 15 / 10.0).cast("double").alias("panel_efficiency"),
    ))
    parsed = grouped.select("request", F.from_json(request, readers.SOLAR_REQUEST).alias("r")).select("request", "r.*")
    readings, panels = readers.solar_requests(parsed, ["request"])
    return shown(validate.default_panels(readings, panels).select(SITE, "ts", "GHI", "DHI", "BP", "area_m2", "efficiency"))


MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def solar_files(spark: SparkSession, folder: str) -> DataFrame:
    """Readings written as CSV files and as JSON requests, one for each day of a site, and read back by the readers."""
    target = shared_folder(spark, "solar-files")
    raw = driver.readings(spark, folder).select(SITE, F.date_format("ts", MICROS).alias("datetime"), *SENSORS)
    raw.write.csv(f"{target}/csv", header=True)
    days = raw.groupBy(SITE, F.substring("datetime", 1, 10).alias("day")).agg(
        F.collect_list(F.struct("datetime", *SENSORS)).alias("historical_data"),
        (F.col(SITE) % 30).cast("double").alias("panel_area_m2"), F.lit(0.2).alias("panel_efficiency"),
    )
    days.drop("day").write.json(f"{target}/json")
    requested, panels = readers.read_solar_json(spark, f"{target}/json")
    from_csv = readers.read_solar_csv(spark, f"{target}/csv").withColumns({"file": F.lit("csv"), "area_m2": F.lit(None).cast("double")})
    from_json = requested.join(panels.select(SITE, "area_m2"), SITE).withColumn("file", F.lit("json"))
    return shown(from_csv.unionByName(from_json))


def consumption_files(spark: SparkSession, folder: str) -> DataFrame:
    """Consumption written as CSV with an untidy header and as JSON rows with another name for power, and read back."""
    target = shared_folder(spark, "consumption-files")
    rows = driver.consumption(spark, folder)
    time = F.when(F.col(SITE) % 7 == 0, "n/a").otherwise(F.date_format("ts", MICROS))
    rows.select(F.col(SITE).alias("Site ID"), time.alias("DT"), F.col("kw").alias("Global Active Power")).write.csv(f"{target}/csv", header=True)
    rows.select(SITE, time.alias("datetime"), F.col("kw").alias("Active_Power")).write.json(f"{target}/json")
    from_csv = readers.read_consumption_csv(spark, f"{target}/csv")
    from_json = readers.read_consumption_json(spark, f"{target}/json")
    return shown(from_csv.withColumn("file", F.lit("csv")).unionByName(from_json.withColumn("file", F.lit("json"))))


def tariff_files(spark: SparkSession, folder: str) -> DataFrame:
    """Conditions written as CSV files in site and time order; the reader takes the last row of each site."""
    target = shared_folder(spark, "tariff-files")
    conditions = driver.tariff_conditions(spark, folder)
    conditions.orderBy(SITE, "ts").drop("ts").write.csv(target, header=True)
    return shown(readers.read_tariff_csv(spark, target))


def written_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """The three forecasts written as a run, written again, and read back beside an attempt that broke off."""
    target = shared_folder(spark, "forecasts")
    tables = dict(zip(("solar", "consumption", "tariff"), standins.all_three(spark, folder)))
    day = dt.date(2024, 6, 1)
    first = writers.write_forecasts(tables, target, day)
    written = {
        name: writers.read_forecasts(spark, target, name, day).withColumn("run_date", F.lit(day + dt.timedelta(days=1))) for name in tables
    }
    for name, table in written.items():  # the next day's attempt ends before its note
        table.withColumn("attempt", F.lit("broken")).write.mode("append").partitionBy(*writers.KEYS).parquet(f"{target}/{name}")
    again = writers.write_forecasts(tables, target, day)
    assert first != again
    value = {"solar": "energy_kwh", "consumption": "kwh", "tariff": "tariff"}
    parts = [
        writers.read_forecasts(spark, target, name).select(SITE, F.lit(name).alias("forecast"), "step", F.col(v).alias("y"))
        for name, v in value.items()
    ]
    return shown(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def forecast_rejections(spark: SparkSession, folder: str) -> DataFrame:
    """Sites that get no solar, consumption or tariff forecast, with the reason. A quarter of a household's days is a site."""
    def part(df: DataFrame) -> DataFrame:
        return df.withColumn(SITE, F.col(SITE) * 10 + F.when(F.dayofmonth("ts") % 4 == 0, 0).otherwise(1))

    found = {
        "solar": solar_rejected(part(driver.readings(spark, folder, missing="signup"))),
        "consumption": forecasts.consumption_rejected(part(driver.consumption(spark, folder))),
        "tariff": validate.priced(driver.tariff_input(spark, folder))[1],
    }
    parts = [df.select(SITE, F.lit(name).alias("forecast"), F.col("n").cast("long").alias("n"), "reason") for name, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def hourly_resample(spark: SparkSession, folder: str) -> DataFrame:
    return shown(resample.resample_hourly(driver.consumption(spark, folder)))


def hourly_series(spark: SparkSession, folder: str) -> DataFrame:
    """Feeders with many rows per hour go hourly, the others stay as they are."""
    return shown(resample.hourly_series(driver.feeder_consumption(spark, folder)))


def _houses_and_feeders(spark: SparkSession, folder: str) -> DataFrame:
    feeders = driver.feeder_consumption(spark, folder).withColumn(SITE, -1 - F.col(SITE))
    return driver.consumption(spark, folder).unionByName(feeders)


def resample_rule(spark: SparkSession, folder: str) -> DataFrame:
    """The rule for households and for feeders (numbered from -1 down), next to the median gap where rule B looks at it."""
    both = _houses_and_feeders(spark, folder)
    rule = resample.needs_resample(both).select(SITE, "n", "span_hours", "rule_a", "rule_b", "resample")
    median = F.when(~F.col("rule_a"), F.col("median_gap_s")).alias("median_gap_s")
    return shown(rule.join(resample.median_gap(both), SITE, "left").select(*rule.columns, median))


def gap_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Short and long gaps of every household and feeder, and the shortest of the long ones."""
    counts = resample.gap_counts(_houses_and_feeders(spark, folder).select(SITE, "ts"))
    return shown(counts.select(SITE, "n", "short_gaps", "long_gaps", "shortest_long_s", "span_hours"))


def gap_medians(spark: SparkSession, folder: str) -> DataFrame:
    """Median gap of every household and feeder over its raw rows."""
    return shown(resample.median_gap(_houses_and_feeders(spark, folder)))


def hourly_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly means of each household next to its latest reading's usual value."""
    profiles = resample.hourly_profile(driver.consumption(spark, folder))
    rows = profiles.select(
        SITE,
        F.posexplode("profile").alias("hour", "kw"),
        resample.profile_lookup("profile", F.hour("last_ts")).alias("usual_now"),
    )
    return shown(rows)


def consumption_feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return shown(consumption_features(forecasts.consumption_history(driver.consumption(spark, folder))))


def profile_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """24 hours per household with labels and the site total."""
    forecast = standins.consumption(spark, folder)
    total = F.sum("kwh").over(Window.partitionBy(SITE))
    return shown(forecast.select(
        SITE, "step", scalars.horizon_label("ts").alias("label"), "kwh", scalars.safe_number(total).alias("total_kwh"),
    ))


def feeder_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The same for feeders, whose rows are denser than hourly and get resampled."""
    history = forecasts.consumption_history(driver.feeder_consumption(spark, folder))
    forecast = forecasts.profile_forecast(history)
    return shown(forecast.select(SITE, "step", scalars.horizon_label("ts").alias("label"), "kwh"))


def service_window_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Forecast of feeders from the rows that one request of the service looks at, the last 2000."""
    history = forecasts.consumption_history(driver.feeder_consumption(spark, folder), last=forecasts.REQUEST_ROWS)
    return shown(forecasts.profile_forecast(history).select(SITE, "step", scalars.horizon_label("ts").alias("label"), "kwh"))


def consumption_totals(spark: SparkSession, folder: str) -> DataFrame:
    return shown(forecasts.consumption_total(standins.consumption(spark, folder)))


def residual_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The scaled errors of a base model over each household's last 24 hours, oldest first."""
    features = consumption_features(forecasts.consumption_history(driver.consumption(spark, folder)))
    sequences = residual_sequence(features, standins.consumption_models())
    return shown(sequences.select(SITE, "last_ts", F.posexplode("errors").alias("pos", "error")))


def recursion_24h(spark: SparkSession, folder: str) -> DataFrame:
    """The recursion over 24 hours with a base model and a correction that SQL can repeat."""
    history = forecasts.consumption_history(driver.consumption(spark, folder))
    return shown(recursive_24h(consumption_features(history), resample.hourly_profile(history), standins.consumption_models()))


def tariff_training(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs and label of every past condition and step that the tariff model is fitted on."""
    rows = training_rows(driver.tariff_conditions(spark, folder))
    return shown(rows.select(
        SITE, "ts", "step", "label", "ahead_sin", "ahead_cos", "tariff_lag_1", "tariff_lag_12", "temperature_norm", "hist_avg_norm",
    ))


def last_n_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Last ten readings of each feeder, marked with the very last one, and the first steps of a forecast."""
    raw = driver.feeder_consumption(spark, folder)
    tail = series.preview_tail(raw)
    latest = series.last_row(raw).select(SITE, "ts", F.lit(True).alias("is_last"))
    marked = tail.join(latest, [SITE, "ts"], "left").withColumn("is_last", F.coalesce("is_last", F.lit(False)))
    head = series.head_k(standins.consumption(spark, folder), 3).select(
        (-1 - F.col(SITE)).alias(SITE), "ts", F.col("kwh").alias("kw"), F.lit(False).alias("is_last")
    )
    return shown(marked.unionByName(head))


def sorted_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Consumption in site and time order with the gap to the previous reading."""
    return shown(series.sort_by_time(series.gap_diff(driver.consumption(spark, folder))))


def history_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Last 48 values per site with one appended reading: lags by negative index, mean and std of the tail."""
    history = driver.consumption(spark, folder)
    ahead = series.last_row(history).select(SITE, scalars.add_hours("ts", 1).alias("ts"), (F.col("kw") * 2).alias("kw"))
    hist = F.col("hist")
    arrayed = resample.history_array(series.append_rows(history, ahead), 48)
    arrayed = arrayed.withColumn("hist", arrays.append_value(hist, F.element_at(hist, 1), keep=48))
    return shown(arrayed.select(
        SITE,
        F.size("hist").alias("n"),
        *[arrays.neg_index(hist, k).alias(f"back_{k}") for k in (1, 2, 24, 48, 100)],
        arrays.mean_of(arrays.tail(hist, 6)).alias("mean_6"),
        arrays.std_pop_of(arrays.tail(hist, 24)).alias("std_24"),
        F.element_at(arrays.pad_to(hist, 60), 60).alias("padded_last"),
        F.element_at(arrays.left_pad_first(hist, 60), 1).alias("left_padded_first"),
    ))


def solar_energy(spark: SparkSession, folder: str) -> DataFrame:
    """Three solar steps per site with panels or defaults, next to the site totals."""
    predicted = standins.solar_prediction(driver.readings(spark, folder))
    forecast = forecasts.solar_energy(predicted, driver.panels(spark, folder))
    joined = forecast.join(forecasts.solar_totals(forecast), SITE)
    return shown(joined.select(
        SITE, "step", scalars.horizon_label("ts").alias("label"), "ghi_wm2", "energy_kwh", "category",
        "total_kwh", "avg_ghi", "max_ghi", "avg_kwh",
    ))


def tariff_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The input sequence of each site; lags come from its previous average prices, one per row back."""
    conditions = driver.tariff_conditions(spark, folder)
    prices = conditions.select(SITE, "ts", F.col("historical_avg_tariff").alias("kw")).where("kw IS NOT NULL")
    recent = resample.history_array(prices, 36).select(SITE, F.reverse("hist").alias("recent"))
    valid, _ = validate.priced(driver.tariff_input(spark, folder))
    return shown(tf.tariff_sequence(valid, recent))


def tariff_band(spark: SparkSession, folder: str) -> DataFrame:
    scores = standins.tariff_scores(spark, folder)
    hour = scalars.forecast_hour("hour", "step")
    return shown(scores.select(
        SITE,
        "step",
        scalars.am_pm(hour).alias("time"),
        scalars.hh_label(hour).alias("clock"),
        scalars.day_name("dow").alias("day"),
        scalars.month_name("month").alias("month"),
        scalars.tariff_band("raw", "hist_avg", "demand").alias("tariff"),
    ))


def tariff_summary(spark: SparkSession, folder: str) -> DataFrame:
    forecast = standins.tariff(spark, folder)
    picks = forecast.groupBy(SITE).agg(
        tf.argmax_first("tariff").alias("peak_step"), tf.argmin_first("tariff").alias("cheap_step")
    )
    return shown(tf.tariff_stats(forecast).join(picks, SITE))


def tariff_badges(spark: SparkSession, folder: str) -> DataFrame:
    return shown(tf.tariff_badges(standins.tariff(spark, folder)))


def tariff_top_hours(spark: SparkSession, folder: str) -> DataFrame:
    return shown(tf.top_k_hours(standins.tariff(spark, folder)))


def appliance_hours(spark: SparkSession, folder: str) -> DataFrame:
    return shown(tf.appliance_hours(standins.tariff(spark, folder)))


def next_hour_decision(spark: SparkSession, folder: str) -> DataFrame:
    rows = decisions.next_hour_decision(*standins.all_three(spark, folder))
    return shown(rows.select(
        SITE, "solar_1h", "energy_1h", "solar_label", "energy_label", "has_solar", "has_energy", "has_tariff",
        "inputs_ready", "state", "surplus_kwh", "deficit_kwh", "sell_hour", "max_tariff", "sell_revenue",
        "import_cost", "next_tariff", "cheap_hour_label", "min_tariff",
    ))


def next_hour_join(spark: SparkSession, folder: str) -> DataFrame:
    """Next solar hour with next consumption hour by position."""
    return shown(decisions.join_next_hour(standins.solar(spark, folder), standins.consumption(spark, folder)).drop("ts"))


def energy_balance_3h(spark: SparkSession, folder: str) -> DataFrame:
    """Site balance, and hour by hour where a site has both forecasts."""
    inputs = decisions.solar_inputs(standins.solar(spark, folder)).join(
        decisions.energy_inputs(standins.consumption(spark, folder)), SITE, "full"
    )
    totals = decisions.balance_3h(inputs.fillna(0, ["has_solar", "has_energy"]), keep=["makes", "uses"])
    hours = decisions.balance_hours(totals).drop("makes", "uses")
    return shown(hours.withColumn("time", scalars.time_of_label("label")))


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    return shown(decisions.timeline_sort(decisions.timeline(*standins.all_three(spark, folder))))


def lowest_cost(spark: SparkSession, folder: str) -> DataFrame:
    return shown(decisions.lowest_cost_hour(standins.consumption(spark, folder), standins.tariff(spark, folder)))


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.recommendations(*standins.all_three(spark, folder))


def best_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Best solar hour and price windows per site."""
    best = decisions.best_solar_hour(standins.solar(spark, folder))
    return shown(best.join(decisions.price_windows(standins.tariff(spark, folder)), SITE, "full"))


def chart_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The tables behind the solar, consumption, tariff and next-hour charts, in one long table."""
    return shown(decisions.chart_tables(*standins.all_three(spark, folder)))


@contextmanager
def _feature_table(spark: SparkSession, folder: str) -> Iterator[DataFrame]:
    """The solar features, kept while something is fitted on them."""
    features = sf.solar_features(driver.readings(spark, folder)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield features
    finally:
        features.unpersist()


def scaled_features(spark: SparkSession, folder: str) -> DataFrame:
    """The 77 features in units of the distance of their quartiles, from the median."""
    with _feature_table(spark, folder) as features:
        rows = scale_features(features, fit_scales(features)[0])
    return shown(rows.select(SITE, "ts", *[F.col("x")[i].alias(c) for i, c in enumerate(FEATURES)]))


def feature_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """F statistic and mutual information with the next hour of all 924 elements of the lookback vectors."""
    with _feature_table(spark, folder) as features:
        scale, target = fit_scales(features)
        use_checkpoint_dir(spark)
        ranks = element_ranks(scale_features(features, scale), target).checkpoint()  # while the features are kept
    return shown(ranks)


def _recent_features(spark: SparkSession, folder: str) -> DataFrame:
    """The features of the last rows only, which is what forecasts look at."""
    return sf.solar_features(sf.scoring_readings(driver.readings(spark, folder)), bounded=True)


# Places that the closed forms use: a line each on two elements, then least squares on the first line's prediction.
LINES = [place("GHI_rolling_mean_3"), place("DNI", 2)]
STACKED = [place("T_amb", 1), place("GHI_lag_1"), WIDTH, WIDTH + 1]


def stacked_vector(spark: SparkSession, folder: str) -> DataFrame:
    """What the models of the hours look at for each site's last row: scaled elements and the lines' predictions."""
    with _feature_table(spark, folder) as features:
        models = fit_linear_solar(features, LINES, STACKED)
    vectors = last_chosen(_recent_features(spark, folder), models, bounded=True)
    return shown(vectors.select(SITE, "last_ts", F.posexplode(vector_to_array("chosen")).alias("pos", "x")))


def _linear_solar(spark: SparkSession, folder: str) -> DataFrame:
    with _feature_table(spark, folder) as features:
        models = fit_linear_solar(features, LINES[:1], [WIDTH])
    return solar_direct_3h(_recent_features(spark, folder), models, bounded=True)


def linear_solar_3h(spark: SparkSession, folder: str) -> DataFrame:
    """The solar forecast with the stack fitted in closed form."""
    return shown(_linear_solar(spark, folder))


def _linear_consumption(spark: SparkSession, folder: str) -> DataFrame:
    history = forecasts.consumption_history(driver.consumption(spark, folder))
    features = consumption_features(history).persist(StorageLevel.MEMORY_AND_DISK)
    models = fit_linear_consumption(features, ["lag_1", "lag_24"])
    forecast = recursive_24h(features, resample.hourly_profile(history), models)
    features.unpersist()  # the last steps go on from a checkpoint
    return forecast


def linear_consumption_24h(spark: SparkSession, folder: str) -> DataFrame:
    """The consumption forecast with base model and correction fitted in closed form."""
    return shown(_linear_consumption(spark, folder))


def _linear_tariff(spark: SparkSession, folder: str) -> DataFrame:
    return tariff_12h(driver.tariff_conditions(spark, folder), lambda c: fit_linear_tariff(c, ["hist_avg_norm"]))


def linear_tariff_12h(spark: SparkSession, folder: str) -> DataFrame:
    """The tariff forecast with the score fitted in closed form."""
    return shown(_linear_tariff(spark, folder))


def fitted_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """From readings to decisions: models fitted, the three forecasts written as a run, read back and decided on."""
    target, day = shared_folder(spark, "fitted-forecasts"), dt.date(2024, 6, 1)
    solar = forecasts.solar_energy(_linear_solar(spark, folder), driver.panels(spark, folder))
    tables = {"solar": solar, "consumption": _linear_consumption(spark, folder), "tariff": _linear_tariff(spark, folder)}
    writers.write_forecasts(tables, target, day)
    rows = decisions.next_hour_decision(*[writers.read_forecasts(spark, target, name, day) for name in tables])
    return shown(rows.select(
        SITE, "solar_1h", "energy_1h", "solar_label", "inputs_ready", "state", "surplus_kwh", "deficit_kwh", "sell_hour",
        "max_tariff", "sell_revenue", "import_cost", "cheap_hour_label",
    ))


def solar_responses(spark: SparkSession, folder: str) -> DataFrame:
    """The answers to solar requests, one row for each forecast in them."""
    answers = forecasts.solar_response(standins.solar(spark, folder), driver.panels(spark, folder))
    rows = answers.select("*", F.explode("forecasts").alias("f")).drop("forecasts")
    return shown(rows.select(*[c for c in rows.columns if c != "f"], "f.*"))


def consumption_responses(spark: SparkSession, folder: str) -> DataFrame:
    """The answers to consumption requests, one row for each forecast in them."""
    answers = forecasts.consumption_response(standins.consumption(spark, folder))
    rows = answers.select("*", F.explode("forecasts").alias("f")).drop("forecasts")
    return shown(rows.select(*[c for c in rows.columns if c != "f"], "f.*"))


def holdout_consumption(spark: SparkSession, folder: str) -> DataFrame:
    """Error of the profile forecast over each household's last day, next to the last value and the day before."""
    hourly = resample.resample_hourly(driver.consumption(spark, folder))
    return shown(forecasts.holdout_errors(hourly, forecasts.profile_forecast))


def tariff_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Tariff conditions of all customers from shared settings: the last event's time and, for some, its temperature."""
    last = series.last_row(driver.tariff_conditions(spark, folder))
    temp = F.when(F.col(SITE) % 3 > 0, F.col("temperature") * 3 - 30)
    settings = last.select(SITE, F.col("ts").alias("shared_ts"), temp.alias("shared_temp"), F.col("historical_avg_tariff").alias("hist_avg"))
    sites = driver.table(spark, folder, "customer").select(F.col("c_custkey").cast("long").alias(SITE))
    return shown(validate.default_tariff_input(sites, settings))


def ml_solar_3h(spark: SparkSession, folder: str) -> DataFrame:
    """Three hours of every site with enough readings from fitted trees. `sound`: energy and category follow from an
    irradiance that isn't negative."""
    panels = driver.panels(spark, folder)
    forecast = validate.default_panels(solar_3h(driver.readings(spark, folder), panels), panels)
    energy = F.col("ghi_wm2") * F.col("area_m2") * F.col("efficiency") / 1000
    near = F.abs(F.col("energy_kwh") - energy) <= 0.005 * F.col("area_m2") * F.col("efficiency") / 1000 + 0.0001
    sound = (F.col("ghi_wm2") >= 0) & (F.col("ghi_wm2") < 3000) & near & (F.col("category") == scalars.irradiance_category("ghi_wm2"))
    return forecast.select(SITE, "step", "ts", F.coalesce(sound, F.lit(False)).alias("sound"))


def ml_consumption_24h(spark: SparkSession, folder: str) -> DataFrame:
    """24 hours of every household from fitted trees. `sound`: at or above the floor, and no more than twice what was seen."""
    readings = driver.consumption(spark, folder)
    most = readings.agg(F.max("kw")).first()[0]
    sound = (F.col("kwh") >= resample.PROFILE_FLOOR) & (F.col("kwh") <= 2 * (most or 0.0))
    return consumption_24h(readings).select(SITE, "step", "ts", F.coalesce(sound, F.lit(False)).alias("sound"))


def ml_tariff_12h(spark: SparkSession, folder: str) -> DataFrame:
    """12 hours of every priced site from a fitted score. `sound`: within the band around the site's average price."""
    conditions = driver.tariff_conditions(spark, folder)
    current = validate.priced(tf.tariff_bounds(series.last_row(conditions)))[0].select(SITE, "hist_avg", "demand")
    low, high = (F.greatest(F.lit(1.0), F.least(F.lit(25.0), scalars.tariff_band(F.lit(x), "hist_avg", "demand"))) for x in (-1e3, 1e3))
    rows = tariff_12h(conditions).join(current, SITE)
    return rows.select(SITE, "step", "hour", F.coalesce(F.col("tariff").between(low - 1e-9, high + 1e-9), F.lit(False)).alias("sound"))


QUERIES: dict[str, Query] = {
    "solar_calendar": solar_calendar,
    "solar_ratios": solar_ratios,
    "solar_lags": solar_lags,
    "solar_rolling": solar_rolling,
    "solar_ewm": solar_ewm,
    "solar_ewm_gaps": solar_ewm_gaps,
    "long_site_averages": long_site_averages,
    "long_site_filled": long_site_filled,
    "long_site_features": long_site_features,
    "solar_modes": solar_modes,
    "solar_features": solar_features,
    "solar_lookback": solar_lookback,
    "solar_min_rows": solar_min_rows,
    "sensor_range_checks": sensor_range_checks,
    "ingest_csv": ingest_csv,
    "ingest_json": ingest_json,
    "ingest_requests": ingest_requests,
    "solar_files": solar_files,
    "consumption_files": consumption_files,
    "tariff_files": tariff_files,
    "written_forecasts": written_forecasts,
    "forecast_rejections": forecast_rejections,
    "hourly_resample": hourly_resample,
    "hourly_series": hourly_series,
    "resample_rule": resample_rule,
    "gap_counts": gap_counts,
    "gap_medians": gap_medians,
    "hourly_profile": hourly_profile,
    "consumption_features": consumption_feature_table,
    "profile_forecast": profile_forecast,
    "feeder_forecast": feeder_forecast,
    "service_window_forecast": service_window_forecast,
    "consumption_totals": consumption_totals,
    "residual_errors": residual_errors,
    "recursion_24h": recursion_24h,
    "tariff_training": tariff_training,
    "last_n_readings": last_n_readings,
    "sorted_readings": sorted_readings,
    "history_arrays": history_arrays,
    "solar_energy": solar_energy,
    "tariff_frames": tariff_frames,
    "tariff_band": tariff_band,
    "tariff_summary": tariff_summary,
    "tariff_badges": tariff_badges,
    "tariff_top_hours": tariff_top_hours,
    "appliance_hours": appliance_hours,
    "next_hour_decision": next_hour_decision,
    "next_hour_join": next_hour_join,
    "energy_balance_3h": energy_balance_3h,
    "timeline": timeline,
    "lowest_cost": lowest_cost,
    "recommendations": recommendations,
    "best_windows": best_windows,
    "chart_tables": chart_tables,
    "scaled_features": scaled_features,
    "feature_ranks": feature_ranks,
    "stacked_vector": stacked_vector,
    "linear_solar_3h": linear_solar_3h,
    "linear_consumption_24h": linear_consumption_24h,
    "linear_tariff_12h": linear_tariff_12h,
    "fitted_decisions": fitted_decisions,
    "solar_responses": solar_responses,
    "consumption_responses": consumption_responses,
    "holdout_consumption": holdout_consumption,
    "tariff_defaults": tariff_defaults,
    "ml_solar_3h": ml_solar_3h,
    "ml_consumption_24h": ml_consumption_24h,
    "ml_tariff_12h": ml_tariff_12h,
}
