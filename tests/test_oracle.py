"""Every registered query against its SQL on the benchmark tables; the fitted ones by their invariants."""

import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry_point  # noqa: E402
from gridwise.plans import queries as registered  # noqa: E402
from gridwise.plans.consumption_model import consumption_24h  # noqa: E402
from gridwise.plans.solar_model import solar_3h  # noqa: E402
from gridwise.plans.tariff_model import tariff_12h  # noqa: E402
from gridwise.sources import driver  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert {c: TYPES[k] for c, k in df.dtypes} == {c: str(t) for c, t in zip(want.columns, want.types)}
    columns = sorted(df.columns)
    got, expected = (
        x[columns].sort_values(columns, ignore_index=True) for x in (df.toPandas(), want.df())
    )
    assert len(got)
    pd.testing.assert_frame_equal(got, expected, check_dtype=False, check_exact=True)


def test_no_query_lacks_sql():
    assert set(registered.QUERIES) <= set(SQL)


@pytest.mark.parametrize("name, steps", [("ml_solar_3h", 3), ("ml_consumption_24h", 24), ("ml_tariff_12h", 12)])
def test_fitted_queries(spark, name, steps):
    """The queries show that values are sound; the values themselves are those of the forecasts behind them."""
    rows = QUERIES[name](spark, SF).toPandas()
    per_site = rows.groupby("site_id")["step"]
    assert len(rows) and (per_site.count() == steps).all() and (per_site.max() == steps).all() and rows["sound"].all()
    forecast, value = {
        "ml_solar_3h": (lambda: solar_3h(driver.readings(spark, SF), driver.panels(spark, SF)), "energy_kwh"),
        "ml_consumption_24h": (lambda: consumption_24h(driver.consumption(spark, SF)), "kwh"),
        "ml_tariff_12h": (lambda: tariff_12h(driver.tariff_conditions(spark, SF)), "tariff"),
    }[name]
    values = forecast().toPandas()
    assert len(values) == len(rows) and (values[value] >= 0).all()


def test_entry(spark):
    assert entry_point.entry(spark).count() == 15 * 24
