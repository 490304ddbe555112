"""Windows over cut-up sites give the rows that one window per site gives."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from gridwise.operators import resample, series, solar_features as sf
from gridwise.operators.scan import Averages, LastKnown
from gridwise.schemas import FEATURES, READINGS, SENSORS, SITE

START = dt.datetime(2024, 3, 1, 5)


def reading_rows(site, n, seed, step_minutes=60, equal_times=False):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        ts = START if equal_times else START + dt.timedelta(minutes=step_minutes * i)
        out.append((site, ts, *[float(x) for x in rng.uniform(0, 500, len(SENSORS))]))
    return out


@pytest.fixture(scope="module")
def skewed(spark):
    """One site with most of the rows, one whose rows share a single time, and three short ones."""
    rows = reading_rows(1, 1500, 1) + reading_rows(2, 700, 2, equal_times=True)
    for site in (3, 4, 5):
        rows += reading_rows(site, 40, site)
    rng = np.random.default_rng(0)
    rng.shuffle(rows)
    rows = [(int(r[0]), r[1], *map(float, r[2:])) for r in rows]
    return spark.createDataFrame(rows, READINGS).repartition(5).cache()


def by_key(df, columns):
    pdf = df.toPandas()
    return pdf.sort_values([SITE, "ts", "GHI"], ignore_index=True)[columns]


@pytest.mark.parametrize("size", [300, 333, 699])
def test_long_sites_give_the_same_features(skewed, size):
    plain = by_key(sf.solar_features(skewed, bounded=True), [SITE, "ts", "GHI", *FEATURES])
    cut = by_key(sf.solar_features(skewed, rows_per_block=size), [SITE, "ts", "GHI", *FEATURES])
    assert len(plain) == 1500 - 24 + 700 - 24 + 3 * 16
    pd.testing.assert_frame_equal(plain, cut, check_exact=False, rtol=1e-11, atol=1e-9)


def test_blocks_are_bounded(skewed):
    sizes = []

    def build(df, w):
        sizes.append(df.groupBy(SITE, "block").count().agg(F.max("count")).first()[0])
        return df.withColumn("prev", F.lag("GHI").over(w))

    out = series.over_series(skewed, build, before=3, after=2, rows_per_block=100)
    assert out.count() == skewed.count()
    assert sizes == [105]


def test_no_long_site_means_no_split(skewed):
    assert series.long_sites(skewed, 1500) is None
    assert {r[SITE] for r in series.long_sites(skewed, 699).collect()} == {1, 2}


def test_frames_longer_than_a_block_are_refused(skewed):
    with pytest.raises(ValueError):
        series.over_series(skewed, lambda d, w: d, before=50, rows_per_block=20)


@pytest.mark.parametrize("rows_per_block", [10, 10_000])
def test_last_n_rows(skewed, rows_per_block):
    got = series.last_n_rows(skewed, 7, rows_per_block=rows_per_block).toPandas()
    pdf = skewed.toPandas().sort_values([SITE, "ts", *SENSORS])
    want = pdf.groupby(SITE).tail(7)
    assert sorted(got["GHI"]) == sorted(want["GHI"])


def test_last_row_matches_last_n(skewed):
    a = series.last_row(skewed).toPandas().sort_values(SITE, ignore_index=True)
    b = series.last_n_rows(skewed, 1).toPandas().sort_values(SITE, ignore_index=True)
    pd.testing.assert_frame_equal(a, b)


def test_gap_diff_and_median(spark, skewed):
    gaps = series.gap_diff(skewed, rows_per_block=200).groupBy(SITE).agg(F.count("gap_s").alias("n"), F.sum("gap_s").alias("s"))
    rows = {r[SITE]: (r["n"], r["s"]) for r in gaps.collect()}
    assert rows[1] == (1499, 1499 * 3600) and rows[2] == (699, 0) and rows[3] == (39, 39 * 3600)
    uneven = spark.createDataFrame(
        [(1, START + dt.timedelta(seconds=s), 1.0) for s in (0, 10, 40, 100, 100, 400)], "site_id long, ts timestamp_ntz, kw double"
    )
    assert resample.median_gap(uneven).first()["median_gap_s"] == 30


def test_ewm_matches_pandas(spark):
    rows = reading_rows(1, 900, 11)
    df = spark.createDataFrame(rows, READINGS)
    got = sf.ewm_mean(df, series.site_window(df)).orderBy("ts").toPandas()
    ghi = pd.Series([r[2] for r in rows])
    for span in (3, 6, 12):
        np.testing.assert_allclose(got[f"GHI_ema_{span}"], ghi.ewm(span=span, adjust=False).mean(), rtol=1e-13)


@pytest.mark.parametrize("n", [1, 2, 23, 24, 25, 35, 36, 200])
def test_features_match_pandas(spark, n):
    rows = reading_rows(9, n, n)
    df = spark.createDataFrame(rows[::-1], READINGS)
    got = sf.solar_features(df, bounded=True).orderBy("ts").toPandas()
    assert len(got) == max(0, n - 24)
    if got.empty:
        return
    ghi = pd.Series([r[2] for r in rows])
    tail = slice(24, None)
    np.testing.assert_allclose(got["GHI_lag_24"], ghi.shift(24)[tail])
    np.testing.assert_allclose(got["GHI_diff_6"], ghi.diff(6)[tail])
    np.testing.assert_allclose(got["GHI_rolling_std_12"], ghi.rolling(12, min_periods=1).std().fillna(0)[tail])
    np.testing.assert_allclose(got["GHI_rolling_min_3"], ghi.rolling(3, min_periods=1).min()[tail])
    for i, width in enumerate((3, 5, 9, 17, 33, 65, 129), 1):
        mean = ghi.rolling(width, center=True, min_periods=1).mean()
        np.testing.assert_allclose(got[f"VMD_mode_{i}"], mean[tail])
    assert list(got.columns) == [SITE, "ts", "GHI", *FEATURES] and len(FEATURES) == 77


def test_scoring_cut_gives_the_same_last_rows(spark):
    df = spark.createDataFrame(reading_rows(1, 800, 5) + reading_rows(2, 35, 6) + reading_rows(3, 36, 7), READINGS)
    whole = sf.lookback_matrix(sf.solar_features(df)).orderBy(SITE).collect()
    cut = sf.lookback_matrix(sf.solar_features(sf.scoring_readings(df), bounded=True), bounded=True).orderBy(SITE).collect()
    assert [r[SITE] for r in whole] == [1, 3] == [r[SITE] for r in cut]
    for a, b in zip(whole, cut):
        assert len(a["lookback"]) == 12 * 77
        np.testing.assert_allclose(a["lookback"], b["lookback"], rtol=1e-11, atol=1e-9)


def test_all_lookbacks(spark):
    rows = [(1, START + dt.timedelta(hours=i), float(i), [float(i), -float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, GHI double, x array<double>")
    out = sf.all_lookbacks(df, 3).orderBy("ts").collect()
    assert len(out) == 40 - 11 - 3
    assert out[0]["lookback"] == [v for i in range(12) for v in (float(i), -float(i))]
    assert (out[0]["y1"], out[0]["y3"]) == (12.0, 14.0)


def averaged(spark, values, spans):
    rows = [(1, START + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, GHI double")
    return series.scanned(df, Averages("GHI", tuple(spans))).orderBy("ts").toPandas()


@pytest.mark.parametrize("missing", [[0, 1, 2], [30], [57, 58, 59], [5, 6, 7, 8, 20, 40], []])
def test_averages_follow_gaps_like_pandas(spark, missing):
    values = [None if i in missing else float(x) for i, x in enumerate(np.random.default_rng(3).uniform(0, 500, 60))]
    spans = [3, 12, 24, 48, 100]
    got = averaged(spark, values, spans)
    for span in spans:
        want = pd.Series(values, dtype=float).ewm(span=span, adjust=False).mean()
        np.testing.assert_allclose(got[f"GHI_ema_{span}"].astype(float), want, rtol=1e-12)


def test_averages_of_long_spans_see_the_whole_history(spark):
    values = [float(x) for x in np.random.default_rng(4).uniform(0, 500, 1500)]
    got = averaged(spark, values, [48, 100])
    for span in (48, 100):
        np.testing.assert_allclose(got[f"GHI_ema_{span}"], pd.Series(values).ewm(span=span, adjust=False).mean(), rtol=1e-12)


def test_averages_of_cut_series_with_gaps(spark):
    rng = np.random.default_rng(5)
    rows = [(1, START + dt.timedelta(hours=i), None if rng.random() < 0.1 else float(rng.uniform(0, 500))) for i in range(2000)]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, GHI double")
    cut = series.scanned(df, sf.AVERAGES, rows_per_block=300).orderBy("ts").toPandas()
    whole = series.scanned(df, sf.AVERAGES).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(cut, whole, rtol=1e-12)


def with_outages(spark):
    """Two long sites and a short one; outages of 1, 250 and 700 rows, at the start, over blocks' edges and at the end."""
    rng, rows = np.random.default_rng(6), []
    for site, n, gaps in ((1, 2400, [(380, 1080), (1199, 1201), (1500, 1750)]), (2, 1300, [(0, 450), (1000, 1300)]), (3, 50, [(0, 3), (20, 30)])):
        for i in range(n):
            missing = any(a <= i < b for a, b in gaps) or i % 17 == 5
            rows.append((site, START + dt.timedelta(hours=i), None if missing else float(rng.uniform(0, 500))))
    rows += [(4, START + dt.timedelta(hours=i), None) for i in range(500)]
    return rows, spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, GHI double").repartition(7)


@pytest.mark.parametrize("size", [100, 400, 401])
def test_averages_do_not_depend_on_the_cut(spark, size):
    rows, df = with_outages(spark)
    averages = Averages("GHI", (3, 12, 48))
    cut = series.scanned(df, averages, rows_per_block=size).orderBy(SITE, "ts").toPandas()
    whole = series.scanned(df, averages, bounded=True).orderBy(SITE, "ts").toPandas()
    pd.testing.assert_frame_equal(cut, whole, rtol=1e-12)
    for site in (1, 2, 3, 4):
        values = pd.Series([r[2] for r in rows if r[0] == site], dtype=float)
        for span in averages.spans:
            got = cut.loc[cut[SITE] == site, averages.name(span)].astype(float)
            np.testing.assert_allclose(got, values.ewm(span=span, adjust=False).mean(), rtol=1e-12)


@pytest.mark.parametrize("size", [100, 401, 5000])
def test_fills_do_not_depend_on_the_cut(spark, size):
    rows, df = with_outages(spark)
    got = resample.ffill_bfill(df, "GHI", rows_per_block=size).orderBy(SITE, "ts").toPandas()
    want = pd.DataFrame(rows, columns=[SITE, "ts", "GHI"]).astype({"GHI": float})
    want["GHI"] = want.groupby(SITE)["GHI"].transform(lambda x: x.ffill().bfill())
    pd.testing.assert_series_equal(got["GHI"].astype(float), want["GHI"])


def test_blocks_of_a_scan_are_bounded(spark):
    sizes = []

    class Seen(LastKnown):
        def blocks(self, df, most):
            sizes.append((df.groupBy(SITE, "block").count().agg(F.max("count")).first()[0], most))
            return super().blocks(df, most)

    _, df = with_outages(spark)
    assert series.scanned(df, Seen("GHI"), rows_per_block=100).count() == df.count()
    assert sizes == [(100, 24)]


def test_wide_rows_are_dealt_by_number(spark, monkeypatch):
    """However few bytes the readings have, no task builds features of many more rows than it is meant to."""
    monkeypatch.setattr(series, "ROWS_PER_TASK", 100)
    rows = [r for site in range(40) for r in reading_rows(site, 30, site)]
    df = spark.createDataFrame(rows, READINGS).repartition(3)
    largest = lambda d: d.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    recent = sf.scoring_readings(df)
    assert recent.count() == df.count() and largest(recent) <= 300
    features = sf.solar_features(df)
    assert features.count() == 40 * 6 and largest(features) <= 60
    assert largest(sf.lookback_matrix(sf.solar_features(sf.scoring_readings(df, 6), bounded=True), lookback=6, bounded=True)) <= 10
