"""Exact statistics against plain computations over the same rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridwise.operators import statistics as st

START = dt.datetime(2024, 6, 1)


def columns(seed, n):
    rng = np.random.default_rng(seed)
    return {
        "normal": rng.normal(0, 3, n), "ties": rng.integers(0, 4, n).astype(float), "constant": np.full(n, 2.5),
        "outliers": np.where(rng.random(n) < 0.01, 1e300, rng.random(n)), "tiny": rng.random(n) * 1e-300,
        "wide": rng.choice([-1.7e308, -1.0, 0.0, 1e-320, 1.7e308], n), "steps": np.repeat([1.0, 1.0000000000000002], [n // 2, n - n // 2]),
    }


@pytest.mark.parametrize("n", [1, 2, 3, 500, 5001])
@pytest.mark.parametrize("parts", [1024, 3])
def test_quantiles(spark, monkeypatch, n, parts):
    monkeypatch.setattr(st, "PARTS", parts)
    data = columns(n, n)
    rows = [tuple(float(data[c][i]) for c in data) for i in range(n)]
    rows += [(None,) * len(data), (math.nan,) * len(data)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(3)
    chances = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = st.exact_quantiles(df, list(data), chances)
    for c, values in data.items():
        ordered = np.sort(values)
        for p, x in zip(chances, got[c]):
            at = p * (n - 1)
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert x == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12) or not math.isfinite(high - low)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (math.nan,)], "x double")
    assert all(map(math.isnan, st.exact_quantiles(df, ["x"])["x"]))
    assert st.fit_scale(df, ["x"]) == st.Scale([0.0], [1.0])
    assert st.fit_scale(df.limit(0), ["x"]) == st.Scale([0.0], [1.0])


def test_counting_does_not_multiply_rows(spark):
    """What a task hands on for quantiles and ranks are counts; its rows aren't multiplied by columns."""
    df = spark.createDataFrame([(float(i), float(-i)) for i in range(100)], "a double, b double")
    plans, collect = [], type(df).collect

    def seen(self):
        plans.append(self._jdf.queryExecution().optimizedPlan().toString())
        return collect(self)

    type(df).collect = seen
    try:
        assert st.exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [49.5], "b": [-49.5]}
    finally:
        type(df).collect = collect
    rows = spark.createDataFrame([(1, START + dt.timedelta(hours=i), [1.0, float(i)], float(i)) for i in range(20)], "site_id long, ts timestamp_ntz, x array<double>, y double")
    plans.append(st.lagged_ranks(rows, 3)._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans) > 1 and not any("Generate" in p for p in plans)


def test_scales(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(1, 10)], "x double, same double")
    scale = st.fit_scale(df, ["x", "same"])
    assert scale == st.Scale([5.0, 7.0], [4.0, 1.0])
    row = df.select(scale.scaled(F.col("x")).alias("a"), scale.restored(scale.scaled(F.col("same"), 1), 1).alias("b")).first()
    assert (row["a"], row["b"]) == (-1.0, 7.0)


@pytest.mark.parametrize("ridge", [0.0, 0.3])
def test_linear_fit(spark, ridge):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 2, (300, 3))
    x[:, 2] = 1.0
    y = 2 + 0.5 * x[:, 0] - 3 * x[:, 1] + rng.normal(0, 0.1, 300)
    rows = [(list(map(float, a)), float(b)) for a, b in zip(x, y)] + [([1.0, 2.0, 3.0], None)]
    df = spark.createDataFrame(rows, "a array<double>, y double").withColumn("v", array_to_vector("a")).repartition(4)
    model = st.fit_linear(df, "v", [1, 0, 2], "y", "p", ridge)
    centred = x[:, [1, 0]] - x[:, [1, 0]].mean(axis=0)
    gram = centred.T @ centred / 300
    want = np.linalg.solve(gram + ridge * np.diag(np.diag(gram)), centred.T @ (y - y.mean()) / 300)
    np.testing.assert_allclose(model.weights, [*want, 0.0], rtol=1e-9)
    assert model.intercept == pytest.approx(y.mean() - want @ x[:, [1, 0]].mean(axis=0))
    got = model.transform(df.where("y IS NOT NULL")).select(F.avg("p")).first()[0]
    assert got == pytest.approx(y.mean())
    assert st.fit_linear(df.where("y > 1e9"), "v", [0], "y", "p").weights == [0.0]


def test_ranks_equal_those_of_built_vectors(spark):
    rng = np.random.default_rng(4)
    rows, lookback = [], 3
    for site in (1, 2, 3):
        for i in range(40):
            values = [float(rng.normal()), math.sin(i / 3) + site, 0.25]
            label = values[1] * 0.5 + float(rng.normal()) * 0.1 if 2 <= i < 37 else None
            rows.append((site, START + dt.timedelta(hours=i), values, label))
    df = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, x array<double>, y double").repartition(5)
    got = {(r["lag"], r["column"]): (r["f"], r["mi"]) for r in st.lagged_ranks(df, lookback).collect()}
    assert len(got) == 9
    ends = [k for k, r in enumerate(rows) if r[3] is not None]
    y = np.array([rows[k][3] for k in ends])
    cells = lambda v: np.clip(np.floor(v * 2) + 4, 0, 7).astype(int)
    for lag in range(lookback):
        for c in range(3):
            v = np.array([rows[k - lag][2][c] for k in ends])
            if c == 2:
                assert got[lag, c] == (0.0, pytest.approx(0.0, abs=1e-12))
                continue
            r2 = np.corrcoef(v, y)[0, 1] ** 2
            table = np.zeros((8, 8))
            np.add.at(table, (cells(v), cells(y)), 1 / len(y))
            outer = table.sum(1, keepdims=True) * table.sum(0, keepdims=True)
            mi = (table[table > 0] * np.log(table[table > 0] / outer[table > 0])).sum()
            assert got[lag, c] == (pytest.approx(r2 / (1 - r2) * (len(y) - 2)), pytest.approx(mi))
