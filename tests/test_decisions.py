"""Hand-computed decisions: equality, ties, missing forecasts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridwise.functions import scalars
from gridwise.operators import decisions as d, forecasts, tariff as tf, validate
from gridwise.schemas import CONSUMPTION_FORECAST, SITE, SOLAR_FORECAST, TARIFF_FORECAST

T0 = dt.datetime(2024, 5, 1, 9)


def at(h):
    return T0 + dt.timedelta(hours=h)


@pytest.fixture(scope="module")
def tables(spark):
    """1 surplus, 2 deficit, 3 exact balance, 4 no tariff, 5 only tariff, 6 no consumption."""
    solar, con, tar = [], [], []
    for site, kwh in {1: [2.0, 3.0, 3.0], 2: [0.5, 0.1, 0.1], 3: [1.0, 1.0, 1.0], 4: [2.0, 0.0, 0.0], 6: [0.0, 0.0, 0.0]}.items():
        solar += [(site, i, at(i), 100.0 * i, k, "Low ☁️") for i, k in enumerate(kwh, 1)]
    for site in (1, 2, 3, 4):
        con += [(site, i, at(i), 1.0) for i in range(1, 25)]
    for site, start in {1: 9, 2: 22, 3: 9, 5: 0, 6: 9}.items():
        prices = [5.0] * 12 if site == 3 else [5.0, 4.0, 7.0, 4.0, 7.0, 6.0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0]
        tar += [(site, i, (start + i) % 24, p) for i, p in enumerate(prices, 1)]
    return (
        spark.createDataFrame(solar, SOLAR_FORECAST).cache(),
        spark.createDataFrame(con, CONSUMPTION_FORECAST).cache(),
        spark.createDataFrame(tar, TARIFF_FORECAST).cache(),
    )


def test_next_hour(tables):
    rows = {r[SITE]: r for r in d.next_hour_decision(*tables).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6}
    one, two, three = rows[1], rows[2], rows[3]
    assert (one["state"], one["surplus_kwh"], one["sell_hour"], one["sell_revenue"]) == ("surplus", 1.0, "12:00 PM", 7.0)
    assert (two["state"], two["deficit_kwh"], two["import_cost"], two["cheap_hour_label"]) == ("deficit", 0.5, 2.5, "12:00 AM")
    assert (three["state"], three["deficit_kwh"], three["import_cost"]) == ("deficit", 0.0, 0.0)
    assert rows[4]["state"] == "surplus" and rows[4]["sell_revenue"] is None and rows[4]["inputs_ready"] == 2
    assert rows[5]["state"] is None and rows[5]["inputs_ready"] == 1
    assert rows[6]["state"] is None and rows[6]["has_energy"] == 0


def test_balance(tables):
    rows = {r[SITE]: (r["net_kwh"], r["state"]) for r in d.balance_3h(d.site_inputs(*tables)).collect()}
    assert rows == {1: (5.0, "Surplus"), 2: (pytest.approx(-2.3), "Deficit"), 3: (0.0, "Surplus"), 4: (-1.0, "Deficit"), 6: (0.0, "Surplus")}
    hours = d.balance_full_outer(tables[0].where("step < 3"), tables[1]).where("site_id = 1").orderBy("step").collect()
    assert [(r["solar_kwh"], r["use_kwh"], r["label"]) for r in hours] == [
        (2.0, 1.0, "2024-05-01 10:00"), (3.0, 1.0, "2024-05-01 11:00"), (0.0, 1.0, "2024-05-01 12:00")]


def test_next_hour_join_by_position_and_time(tables):
    solar, con, _ = tables
    later = con.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    assert d.join_next_hour(solar, later).count() == 4
    assert d.join_next_hour(solar, later, by="ts").count() == 0
    assert d.join_next_hour(solar, con, by="ts").count() == 4


def test_timeline(tables):
    rows = d.timeline(*tables).collect()
    one = {r["label"]: r for r in rows if r[SITE] == 1}
    # Prices 10:00 .. 21:00 fall on the first label of their hour.
    assert len(one) == 24 and one["2024-05-01 12:00"]["tariff"] == 7.0 and one["2024-05-02 09:00"]["tariff"] == 0.0
    two = {r["label"] for r in rows if r[SITE] == 2}
    assert "2024-05-01 23:00" in two and not any(x.startswith("H") for x in two)
    # Site 6 has solar 10:00 to 12:00 only, so nine prices get rows of their own, which sort last.
    six = [r["label"] for r in d.timeline_sort(d.timeline(*tables)).collect() if r[SITE] == 6]
    assert len(six) == 12 and six[3:] == [f"H{h}:00" for h in range(13, 22)]
    assert {r[SITE] for r in rows} == {1, 2, 3, 4, 6}


def test_timeline_price_goes_to_the_first_label_only(spark):
    solar = spark.createDataFrame([(1, 1, at(24), 1.0, 1.0, "x")], SOLAR_FORECAST)
    con = spark.createDataFrame([(1, i, at(i), 1.0) for i in range(0, 24)], CONSUMPTION_FORECAST)
    tar = spark.createDataFrame([(1, 1, 9, 5.0)], TARIFF_FORECAST)
    rows = {r["label"]: r["tariff"] for r in d.timeline(solar, con, tar).collect()}
    # Solar labels come first, although the consumption label is earlier.
    assert rows["2024-05-02 09:00"] == 5.0 and rows["2024-05-01 09:00"] == 0.0


def test_recommendations(tables):
    rows = d.recommendations(*tables).orderBy(SITE, "priority").collect()
    titles = {}
    for r in rows:
        titles.setdefault(r[SITE], []).append((r["priority"], r["title"].split(" ", 1)[1], r["box"]))
    assert [p for p, *_ in titles[1]] == [1, 2, 3, 4, 5]
    assert titles[1][0][1].startswith("Sell") and titles[2][0][1].startswith("Grid Import") and titles[4][0][1] == "Export Opportunity"
    assert [p for p, *_ in titles[4]] == [1, 2] and [p for p, *_ in titles[5]] == [3, 4] and [p for p, *_ in titles[6]] == [2, 3, 4]
    one = [r["body"] for r in rows if r[SITE] == 1]
    assert "2024-05-01 10:00" in one[0] and "1.0000 kWh" in one[0] and "₹7.00" in one[0]
    assert "2024-05-01 11:00 — 3.0000" in one[1]  # the first of two equal hours
    assert "11:00 (₹4.00/kWh)" in one[2] and "12:00 (₹7.00/kWh)" in one[3]
    assert "2024-05-01 11:00 — ₹4.00" in one[4]


def test_first_extremes_and_stats(tables):
    rows = {r[SITE]: r for r in tf.tariff_stats(tables[2]).collect()}
    one = rows[1]
    assert (one["peak_index"], one["off_peak_index"], one["peak_hour"], one["cheap_hour"]) == (2, 1, 12, 11)
    assert (one["spread"], one["next_tariff"]) == (3.0, 5.0)
    assert (rows[3]["peak_index"], rows[3]["off_peak_index"]) == (0, 0)
    best = {r[SITE]: r["step"] for r in d.best_solar_hour(tables[0]).collect()}
    assert best == {1: 2, 2: 1, 3: 1, 4: 1, 6: 1}
    low = {r[SITE]: (r["step"], r["cost"]) for r in d.lowest_cost_hour(tables[1], tables[2]).collect()}
    assert low == {1: (2, 4.0), 2: (2, 4.0), 3: (1, 5.0)}


def test_badges_and_bars(tables):
    rows = tf.tariff_badges(tables[2]).orderBy("step").collect()
    assert {r["badge"] for r in rows if r[SITE] == 3} == {"Peak"} and {r["bar_pct"] for r in rows if r[SITE] == 3} == {0}
    one = [r["badge"] for r in rows if r[SITE] == 1]
    assert one[:4] == ["Mid", "Off-peak", "Peak", "Off-peak"]
    assert [r["bar_pct"] for r in rows if r[SITE] == 1][:3] == [33, 0, 100]


def test_top_hours_keep_step_order(tables):
    rows = tf.top_k_hours(tables[2]).where("site_id = 1").orderBy("kind", "rank").collect()
    assert [(r["kind"], r["step"]) for r in rows] == [
        ("cheapest", 2), ("cheapest", 4), ("cheapest", 1), ("dearest", 3), ("dearest", 5), ("dearest", 6)]
    text = tf.appliance_hours(tables[2]).where("site_id = 1").first()
    assert text["best_hours"] == "11:00 (₹4.00), 13:00 (₹4.00), 10:00 (₹5.00)" and text["saving_per_kwh"] == 3.0


def test_scalars(spark):
    one = spark.range(1).select(
        scalars.am_pm(F.lit(0)), scalars.am_pm(F.lit(12)), scalars.am_pm(F.lit(13)), scalars.hh_label(F.lit(7)),
        scalars.day_name(F.lit(0)), scalars.month_name(F.lit(12)), scalars.forecast_hour(F.lit(22), F.lit(3)),
        scalars.solar_elevation(F.lit(0)), scalars.solar_elevation(F.lit(12)), scalars.clear_sky_index(F.lit(5.0), F.lit(0.0)),
        scalars.dni_dhi_ratio(F.lit(5.0), F.lit(0.0)), scalars.ghi_to_kwh(F.lit(450.0), F.lit(10.0), F.lit(0.2)),
        scalars.ghi_to_kwh(F.lit(-450.0), F.lit(10.0), F.lit(0.2)), scalars.percent_to_fraction(F.lit(20)),
    ).first()
    assert list(one) == ["12:00 AM", "12:00 PM", "1:00 PM", "07:00", "Mon", "Dec", 1, 0.0, 90.0, 0.0, 0.0, 0.9, 0.0, 0.2]
    bands = spark.createDataFrame([(99.999,), (100.0,), (400.0,), (700.0,)], "g double").select(scalars.irradiance_category("g"))
    assert [r[0].split()[0] for r in bands.collect()] == ["Low", "Moderate", "High", "Excellent"]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-3.0,), (1.23456,)], "x double")
    assert [r[0] for r in odd.select(scalars.safe_number("x")).collect()] == [0, 0, 0, 0, 1.2346]
    assert [r[0] for r in odd.select(scalars.clip("x", 0.0, 1.0)).collect()][2:] == [None, 0.0, 1.0]


@pytest.mark.parametrize("demand", [0.0, 0.5, 1.0])
def test_price_band(spark, demand):
    df = spark.createDataFrame([(r,) for r in (-50.0, 0.0, 50.0)], "raw double")
    low, mid, high = (r[0] for r in df.select(scalars.tariff_band("raw", F.lit(10.0), F.lit(demand))).collect())
    assert (low, mid, high) == pytest.approx((8 - demand, 10.0, 12 + demand))
    assert df.select(scalars.tariff_band("raw", F.lit(100.0), F.lit(demand))).first()[0] == 25.0
    back = df.where("raw = 0").select(scalars.tariff_score(scalars.tariff_band("raw", F.lit(10.0), F.lit(demand)), F.lit(10.0), F.lit(demand)))
    assert back.first()[0] == pytest.approx(0, abs=1e-9)


def test_validation(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 12.0), (2, None)], "site_id long, kw double")
    ok, bad = validate.range_checks(df, validate.CONSUMPTION_RANGES)
    assert ok.count() == 1 and [r["failed"] for r in bad.collect()] == [["kw"], ["kw"]]
    kept, rejected = validate.min_rows(df, 2, "short")
    assert kept.count() == 2 and [(r[SITE], r["n"], r["reason"]) for r in rejected.collect()] == [(2, 1, "short")]
    bad_times = spark.createDataFrame([("2024-01-01 05:00", 1), ("soon", 1), (None, 1)], "datetime string, site_id long")
    assert [r["ts"] for r in validate.parse_ts_drop_bad(bad_times).collect()] == [dt.datetime(2024, 1, 1, 5)]


def test_defaults(spark):
    sites = spark.createDataFrame([(1,), (2,)], "site_id long")
    panels = spark.createDataFrame([(1, 4.0, None)], "site_id long, area_m2 double, efficiency double")
    got = {r[SITE]: (r["area_m2"], r["efficiency"]) for r in validate.default_panels(sites, panels).collect()}
    assert got == {1: (4.0, 0.2), 2: (10.0, 0.2)}
    settings = spark.createDataFrame([(1, at(0), 30.5), (2, at(3), None)], "site_id long, shared_ts timestamp_ntz, shared_temp double")
    rows = {r[SITE]: tuple(r)[1:] for r in validate.default_tariff_input(sites, settings).collect()}
    assert rows == {1: (9, 2, 5, 30.0, 6.5, 0.5), 2: (12, 2, 5, 28.0, 6.5, 0.5)}


def test_solar_energy_and_totals(spark):
    predicted = spark.createDataFrame([(1, 1, at(1), 450.0), (1, 2, at(2), -5.0), (1, 3, at(3), 99.999)], "site_id long, step int, ts timestamp_ntz, ghi double")
    panels = spark.createDataFrame([], "site_id long, area_m2 double, efficiency double")
    forecast = forecasts.solar_energy(predicted, panels)
    rows = forecast.orderBy("step").collect()
    assert [(r["ghi_wm2"], r["energy_kwh"]) for r in rows] == [(450.0, 0.9), (0.0, 0.0), (100.0, 0.2)]
    assert rows[2]["category"].startswith("Low")  # the band looks at the unrounded value
    total = forecasts.solar_totals(forecast).first()
    assert (total["total_kwh"], total["max_ghi"]) == (1.1, 450.0)


def test_tariff_bounds_and_sequence(spark):
    raw = spark.createDataFrame([(1, 30.0, -2.0, 0.0, 70.0, 6.5, 1.4)], "site_id long, hour double, day_of_week double, month double, temperature double, historical_avg_tariff double, demand_index double")
    bounded = tf.tariff_bounds(raw)
    assert tuple(bounded.first()) == (1, 23, 0, 1, 70.0, 6.5, 1.0)
    frames = tf.tariff_sequence(bounded).orderBy("frame").collect()
    assert len(frames) == 24 and [f["frame_hour"] for f in frames] == list(range(24))
    assert frames[0]["tariff_lag_12"] == 0.65 and frames[5]["temperature_norm"] == pytest.approx(50 / 30)
    prices = spark.createDataFrame([(1, [5.0, 4.0, 3.0])], "site_id long, recent array<double>")
    last = tf.tariff_sequence(bounded, prices).where("frame = 23").first()
    assert (last["tariff_lag_1"], last["tariff_lag_2"], last["tariff_lag_3"]) == (0.4, 0.3, 0.65)
