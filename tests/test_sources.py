"""Files written here and read back; the formats of the three inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridwise.schemas import SENSORS, SITE
from gridwise.sources import columns, readers, writers

T0 = dt.datetime(2026, 4, 1, 22)


def solar_lines(n, extra=""):
    head = "datetime," + ",".join(SENSORS) + (",note" if extra else "")
    rows = [f"{(T0 + dt.timedelta(hours=i)):%Y-%m-%d %H:%M}," + ",".join(str(i + j / 10) for j in range(10)) + extra for i in range(n)]
    return "\n".join([head, *rows]) + "\n"


def test_solar_csv(spark, tmp_path):
    path = tmp_path / "solar.csv"
    path.write_text(solar_lines(36, ",x") + "soon," + ",".join(["1"] * 10) + ",x\n2026-04-09 00:00,bad" + ",1" * 9 + ",x\n")
    df = readers.read_solar_csv(spark, str(path), site_id=3)
    assert df.columns == [SITE, "ts", *SENSORS]
    rows = df.orderBy("ts").collect()
    assert len(rows) == 37 and rows[1]["ts"] == T0 + dt.timedelta(hours=1) and rows[1]["DNI"] == 1.1
    assert rows[-1]["GHI"] is None and rows[-1]["BP"] == 1.0
    (tmp_path / "short.csv").write_text("datetime,GHI\n2026-01-01 00:00,1\n")
    with pytest.raises(ValueError, match="BP"):
        readers.read_solar_csv(spark, str(tmp_path / "short.csv"), site_id=1)


def test_consumption_csv(spark, tmp_path):
    path = tmp_path / "use.csv"
    lines = [f"{7 if i < 6 else 8},{T0 + dt.timedelta(hours=i):%Y-%m-%d %H:%M:%S},{i / 2},0" for i in range(12)]
    path.write_text("Site ID, DT ,Global Active Power,Voltage\n".replace("Site ID", "site_id") + "\n".join(lines) + "\n")
    df = readers.read_consumption_csv(spark, str(path), last=4)
    assert df.columns == [SITE, "ts", "kw"]
    got = {s: [r["kw"] for r in df.where(F.col(SITE) == s).orderBy("ts").collect()] for s in (7, 8)}
    assert got == {7: [1.0, 1.5, 2.0, 2.5], 8: [4.0, 4.5, 5.0, 5.5]}
    (tmp_path / "no_time.csv").write_text("when,Global_active_power\n1,2\n")
    with pytest.raises(ValueError, match="datetime"):
        readers.read_consumption_csv(spark, str(tmp_path / "no_time.csv"), site_id=1)
    (tmp_path / "no_target.csv").write_text("dt,watts\n1,2\n")
    with pytest.raises(ValueError, match="global_active_power"):
        readers.read_consumption_csv(spark, str(tmp_path / "no_target.csv"), site_id=1)


def test_tariff_csv_takes_the_last_row(spark, tmp_path):
    path = tmp_path / "tariff.csv"
    path.write_text("Hour,Day of Week,Month,Temperature,Historical Avg Tariff,Demand Index\n9,3,4,28,6.5,0.55\n25,5,13,30,4.5,1.7\n")
    assert tuple(readers.read_tariff_csv(spark, str(path), site_id=1).first()) == (1, 23, 5, 12, 30.0, 4.5, 1.0)
    (tmp_path / "bad.csv").write_text("hour,month\n1,2\n")
    with pytest.raises(ValueError, match="demand_index"):
        readers.read_tariff_csv(spark, str(tmp_path / "bad.csv"), site_id=1)


def test_solar_json(spark, tmp_path):
    def row(i):
        return {"datetime": f"{T0 + dt.timedelta(hours=i):%Y-%m-%d %H:%M}", **{c: float(i) for c in SENSORS}}

    path = tmp_path / "requests.json"
    lines = [
        {"site_id": 1, "historical_data": [row(0), row(1)], "panel_area_m2": 12.0, "panel_efficiency": 0.21},
        {"site_id": 2, "historical_data": [row(2), {**row(3), "datetime": "?"}]},
    ]
    path.write_text("\n".join(map(json.dumps, lines)))
    readings, panels = readers.read_solar_json(spark, str(path))
    assert readings.groupBy(SITE).count().orderBy(SITE).collect() == [(1, 2), (2, 1)]
    assert [tuple(r) for r in panels.orderBy(SITE).collect()] == [(1, 12.0, 0.21), (2, None, None)]


def test_consumption_json_of_any_shape(spark, tmp_path):
    path = tmp_path / "use.json"
    rows = [{"dt": "2024-01-01 05:00:00", "Voltage": 230.5, "power": 1.5}, {"dt": "later", "Voltage": 1.0, "power": 2.0}]
    path.write_text(json.dumps({"site_id": 4, "historical_data": rows}))
    got = readers.read_consumption_json(spark, str(path)).collect()
    assert [tuple(r) for r in got] == [(4, dt.datetime(2024, 1, 1, 5), 1.5)]


def test_column_choice(spark):
    def make(schema):
        return spark.createDataFrame([], "site_id long, " + schema)

    assert columns.target_column(make("datetime string, power double, Active_Power double")) == "Active_Power"
    assert columns.target_column(make("datetime string, note string, watts int")) == "watts"
    with pytest.raises(ValueError):
        columns.target_column(make("datetime string, note string"))
    assert columns.match_target_column(make("hour int, Total_Consumption double")) == "Total_Consumption"
    assert columns.match_target_column(make("x double")) == SITE
    assert columns.time_column(make("dt string, datetime string")) == "datetime"
    assert columns.normalise_header(spark.createDataFrame([(1, 2)], ["  Day of Week ", "B"])).columns == ["day_of_week", "b"]


def test_nan_target_becomes_null(spark):
    df = spark.createDataFrame([(1, "2024-01-01", float("nan"))], "site_id long, datetime string, power double")
    assert columns.resolve_columns(df).first()["kw"] is None


@pytest.mark.parametrize("file_format", ["parquet", "json"])
def test_forecasts_replace_only_their_date(spark, tmp_path, file_format):
    def table(v):
        return spark.createDataFrame([(1, 1, v)], "site_id long, step int, kwh double")

    first, second = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    for day, value in ((first, 1.0), (second, 2.0), (second, 3.0)):
        writers.write_forecasts({"consumption": table(value)}, str(tmp_path), day, file_format)
    assert sorted(p.name for p in (tmp_path / "consumption").glob("run_date=*")) == ["run_date=2024-01-01", "run_date=2024-01-02"]
    if file_format == "parquet":
        assert writers.read_forecasts(spark, str(tmp_path), "consumption", second).first()["kwh"] == 3.0
        assert writers.read_forecasts(spark, str(tmp_path), "consumption").count() == 2


def test_overlapping_solar_requests(spark, tmp_path):
    def row(i, ghi):
        return {"datetime": f"{T0 + dt.timedelta(hours=i):%Y-%m-%d %H:%M}", **{c: 1.0 for c in SENSORS}, "GHI": ghi}

    lines = [
        {"site_id": 1, "historical_data": [row(i, 10.0) for i in range(5)], "panel_area_m2": 12.0, "panel_efficiency": 0.2},
        {"site_id": 1, "historical_data": [row(i, 20.0) for i in range(1, 6)], "panel_area_m2": -3.0, "panel_efficiency": 1.5},
        {"site_id": 2, "historical_data": [row(0, 1.0), row(0, 2.0)], "panel_area_m2": 4.0, "panel_efficiency": 1.0},
        {"site_id": 3, "historical_data": None},
    ]
    path = tmp_path / "requests.json"
    path.write_text("\n".join(map(json.dumps, lines)))
    readings, panels = readers.read_solar_json(spark, str(path))
    got = [(r[SITE], r["ts"], r["GHI"]) for r in readings.orderBy(SITE, "ts").collect()]
    assert got == [(1, T0 + dt.timedelta(hours=i), 20.0 if i else 10.0) for i in range(6)] + [(2, T0, 2.0)]
    assert [tuple(r) for r in panels.orderBy(SITE).collect()] == [(1, None, None), (2, 4.0, 1.0), (3, None, None)]


def forecast_table(spark, value, sites=(1, 2)):
    return spark.createDataFrame([(s, 1, value) for s in sites], "site_id long, step int, kwh double")


def test_repeated_and_broken_runs(spark, tmp_path):
    """A repeated run replaces the first; one that breaks off between its tables, or before its note, is never seen."""
    folder, day, next_day = str(tmp_path), dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    good = {"consumption": forecast_table(spark, 1.0), "solar": forecast_table(spark, 2.0)}
    seen = lambda name, date=None: sorted(r["kwh"] for r in writers.read_forecasts(spark, folder, name, date).collect())
    first = writers.write_forecasts(good, folder, day)
    again = writers.write_forecasts(good, folder, day)
    assert first != again and seen("consumption") == [1.0, 1.0] and seen("solar", day) == [2.0, 2.0]

    fails = forecast_table(spark, 9.0).withColumn("kwh", F.raise_error(F.lit("broke off")).cast("double"))
    for date in (day, next_day):
        with pytest.raises(Exception, match="broke off"):
            writers.write_forecasts({"consumption": forecast_table(spark, 7.0), "solar": fails}, folder, date)
    assert seen("consumption") == [1.0, 1.0] and seen("solar") == [2.0, 2.0] and seen("consumption", next_day) == []

    # The files of attempts that don't count can go; what is read stays.
    assert writers.drop_other_attempts(spark, folder, day) >= 3
    assert seen("consumption") == [1.0, 1.0] and seen("solar") == [2.0, 2.0]
    assert [p.name for p in (tmp_path / "consumption" / "run_date=2024-01-01").glob("attempt=*")] == [f"attempt={again}"]
    assert {(r["name"], r["attempt"]) for r in writers.complete_runs(spark, folder).collect()} == {("consumption", again), ("solar", again)}
    with pytest.raises(ValueError):
        writers.write_forecasts({}, folder, day)


def test_text_formats_are_read_with_a_schema(spark, tmp_path):
    table = forecast_table(spark, 1.5)
    writers.write_forecasts({"consumption": table}, str(tmp_path), dt.date(2024, 1, 1), "csv")
    got = writers.read_forecasts(spark, str(tmp_path), "consumption", file_format="csv", schema=table.schema)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1.5), (2, 1, 1.5)]


def test_power_column_is_found_by_name(spark):
    from gridwise.operators.consumption_features import consumption_features

    rows = [(1, T0 + dt.timedelta(hours=i), 100.0 + i, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, voltage double, Total_Consumption double")
    assert [r["kw"] for r in consumption_features(df).orderBy("ts").collect()] == [0.0, 1.0, 2.0]
    assert [r["kw"] for r in consumption_features(df.drop("Total_Consumption")).orderBy("ts").collect()] == [100.0, 101.0, 102.0]
