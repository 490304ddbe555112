"""Fitted forecasts: shape and value invariants, saving and loading, optional parts."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridwise.operators.consumption_features import consumption_features
from gridwise.operators.forecasts import consumption_history
from gridwise.operators.resample import hourly_profile
from gridwise.operators.solar_features import solar_features
from gridwise.plans import consumption_model as cm, solar_model as sm, tariff_model as tm
from gridwise.schemas import CONSUMPTION, CONSUMPTION_FEATURES, FEATURES, READINGS, SITE
from gridwise.sources import driver

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def readings(spark):
    """Days of changing cloud: a sine arch between sunrise and sunset, with a site-specific height."""
    rows = []
    for site in (1, 2, 3, 4):
        for i in range(24 * 8):
            ts = START + dt.timedelta(hours=i)
            arch = math.sin(math.pi * (ts.hour - 5) / 14) if 5 < ts.hour < 19 else 0.0
            cloud = 0.2 + 0.15 * math.cos(0.7 * i + site)
            ghi = (450.0 + 110 * site) * arch * (1 - cloud)
            rows.append((
                site, ts, ghi, ghi * (1 - cloud), ghi * cloud, 11.0 + 6 * arch, 81.0 - 20 * arch, 2.0 + arch, 4.1 + cloud,
                (40.0 * site + i) % 360, 22.0 - site, 987.0 + 3 * math.sin(i / 9),
            ))
    rows += [(9, START + dt.timedelta(hours=i), *[1.0] * 10) for i in range(35)]
    return spark.createDataFrame(rows, READINGS).cache()


@pytest.fixture(scope="module")
def solar(spark, readings):
    features = solar_features(readings.where("site_id < 9")).cache()
    return features, sm.fit_solar(features)


def test_solar_forecast(spark, readings, solar, tmp_path):
    features, models = solar
    rows = sm.solar_direct_3h(features, models).orderBy(SITE, "step").collect()
    assert [(r[SITE], r["step"]) for r in rows] == [(s, h) for s in (1, 2, 3, 4) for h in (1, 2, 3)]
    last = START + dt.timedelta(hours=24 * 8 - 1)
    assert all(r["ts"] == last + dt.timedelta(hours=r["step"]) and r["ghi"] >= 0 for r in rows)
    # The hours after 23:00 are dark to dim on every day of the history.
    assert max(r["ghi"] for r in rows) < 500
    width = 12 * len(FEATURES)
    assert len(models.bases) == 4 and set(range(width, width + 4)) <= set(models.selected)

    models.save(spark, str(tmp_path))
    again = sm.solar_direct_3h(features, sm.load_solar_models(spark, str(tmp_path))).orderBy(SITE, "step").collect()
    assert again == rows


def test_solar_without_bases_and_selection(spark, solar):
    features, models = solar
    plain = sm.SolarModels(models.scale, models.target, [])
    windows = sm.scale_features(features, models.scale)
    from gridwise.operators.solar_features import last_lookback
    from pyspark.ml.functions import array_to_vector

    last = last_lookback(windows).withColumn("features", array_to_vector("lookback"))
    chosen = sm.hstack_select(sm.stack_meta(last, plain.bases), plain.selected)
    assert chosen.select("chosen").first()[0].size == 12 * len(FEATURES)


def test_selection_holds_the_best_of_each_test(solar):
    features, models = solar
    scale, target = sm.fit_scales(features)
    assert (scale, target) == (models.scale, models.target)
    ranks = sm.element_ranks(sm.scale_features(features, scale), target).cache()
    for test in ("f", "mi"):
        assert set(sm.best_elements(ranks, test, sm.TOP_PER_TEST)) <= set(models.selected)
    assert {p for p in models.selected if p < sm.WIDTH} <= set(models.elements) and len(models.elements) <= 4 * sm.TOP_PER_TEST


@pytest.fixture(scope="module")
def consumption(spark):
    rows = []
    for site in (1, 2, 3):
        for i in range(24 * 6):
            h = (START + dt.timedelta(hours=i)).hour
            # A long plateau by day, an evening step from six to ten, and a ripple over the days.
            load = 0.3 + 0.25 * (9 <= h < 18) + 0.6 * site * (18 <= h < 22) + 0.02 * math.sin(i / 5)
            rows.append((site, START + dt.timedelta(hours=i), load))
    rows += [(5, START + dt.timedelta(hours=i), 1.0) for i in range(24)]
    series = consumption_history(spark.createDataFrame(rows, CONSUMPTION))
    features = consumption_features(series).cache()
    return series, features, cm.fit_consumption(features)


def test_saved_models_know_their_features(spark, consumption, tmp_path):
    series, features, models = consumption
    models.save(spark, str(tmp_path))
    loaded = cm.load_consumption_models(spark, str(tmp_path))
    assert loaded.features == CONSUMPTION_FEATURES
    # Columns in another order and one too many change nothing.
    mixed = features.select(*features.columns[::-1]).withColumn("lag_99", F.lit(5.0))
    want = cm.base_consumption(features, models.base).orderBy(SITE, "ts").collect()
    got = cm.base_consumption(mixed, loaded.base, loaded.features).drop("lag_99").select(*want[0].asDict()).orderBy(SITE, "ts").collect()
    assert got == want


def test_consumption_forecast(spark, consumption, tmp_path):
    series, features, models = consumption
    rows = cm.recursive_24h(features, hourly_profile(series), models).orderBy(SITE, "step").collect()
    assert [(r[SITE], r["step"]) for r in rows] == [(s, h) for s in (1, 2, 3, 5) for h in range(1, 25)]
    assert all(r["kwh"] >= 0.01 for r in rows)
    # The daily shape is followed: the evening peak of the largest site is well above its night.
    three = {r["ts"].hour: r["kwh"] for r in rows if r[SITE] == 3}
    assert three[19] > 2 * three[2]

    models.save(spark, str(tmp_path))
    again = cm.load_consumption_models(spark, str(tmp_path))
    assert cm.recursive_24h(features, hourly_profile(series), again).orderBy(SITE, "step").collect() == rows


def test_consumption_without_correction(spark, consumption, tmp_path):
    series, features, models = consumption
    base_only = cm.ConsumptionModels(models.base)
    base_only.save(spark, str(tmp_path))
    loaded = cm.load_consumption_models(spark, str(tmp_path))
    assert loaded.correction is None
    rows = cm.recursive_24h(features, hourly_profile(series), loaded).collect()
    assert len(rows) == 4 * 24 and min(r["kwh"] for r in rows) >= 0.01


def test_residual_sequence_is_padded(consumption):
    _, features, models = consumption
    short = features.where("site_id = 1").orderBy("ts").limit(5)
    row = cm.residual_sequence(short, models).first()
    assert len(row["errors"]) == 24 and len(set(row["errors"][:20])) == 1 and len(row["hist"]) == 5
    zeros = cm.residual_sequence(short, cm.ConsumptionModels(models.base)).first()
    assert zeros["errors"] == [0.0] * 24


def test_tariff_forecast(spark):
    conditions = driver.tariff_conditions(spark, SF)
    rows = tm.tariff_12h(conditions).orderBy(SITE, "step").collect()
    sites = {r[SITE] for r in rows}
    assert len(rows) == 12 * len(sites) and sites
    assert all(1 <= r["tariff"] <= 25 and 0 <= r["hour"] <= 23 for r in rows)


def test_tariff_training_rows(spark):
    rows = [(1, START + dt.timedelta(hours=i), i % 24, 0, 6, 20.0, 5.0 + i % 3, 0.5) for i in range(20)]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, hour int, day_of_week int, month int, temperature double, historical_avg_tariff double, demand_index double")
    got = tm.training_rows(df)
    assert got.count() == 8 * 12 + sum(range(12))
    one = got.where((F.col("ts") == START + dt.timedelta(hours=3)) & (F.col("step") == 2)).first()
    assert (one["price"], one["tariff_lag_1"], one["tariff_lag_12"]) == (7.0, 0.7, 0.5)
