"""Exact statistics over all rows from small mergeable counts: quantiles, scales, linear fits, ranks of lagged features."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from gridwise.operators.series import over_series
from gridwise.session import find_package

QUARTILES = (0.25, 0.5, 0.75)
# Parts that a range of values is cut into in one pass.
PARTS = 1024
# Cells of a scaled value for mutual information, half a width each; the outer ones are open.
BINS = 8


@dataclass
class _Place:
    """The value of a rank is known to lie from `low` to `high`, with `before` values below `low`."""

    rank: int
    low: float
    high: float
    before: int = 0


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUARTILES) -> dict[str, list[float]]:
    """Quantiles of each column, interpolated between the two values next to them; nulls and NaNs don't count.

    Ranges of values are counted in `PARTS` parts, and the part that holds the wanted rank is counted again from its lowest to
    its highest value, until it holds one value. Each pass reads the rows once and brings at most `PARTS` counts for each
    range to the driver, whatever the number of rows. A column without values gives NaN.
    """
    find_package(df.sparkSession)
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    each = values.mapInArrow(_ends, "column int, n long, a double, b double").groupBy("column")
    found = each.agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
    ends = {columns[r["column"]]: r for r in found.collect()}
    number = {c: ends[c]["n"] if c in ends else 0 for c in columns}
    places: dict[tuple[str, int], _Place] = {}
    for c in columns:
        for p in probabilities if number[c] else ():
            at = p * (number[c] - 1)
            for rank in (math.floor(at), math.ceil(at)):
                places[c, rank] = _Place(rank, ends[c]["a"], ends[c]["b"])
    while ranges := sorted({(c, p.low, p.high) for (c, _), p in places.items() if p.low < p.high}):
        counts = _counted(values, columns, ranges)
        for (c, _), place in places.items():
            if place.low == place.high:
                continue
            for n, low, high in counts[c, place.low, place.high]:
                if place.rank < place.before + n:
                    place.low, place.high = low, high
                    break
                place.before += n
    out = {}
    for c in columns:
        out[c] = []
        for p in probabilities:
            at = p * (number[c] - 1)
            if at < 0:
                out[c].append(math.nan)
                continue
            low, high = places[c, math.floor(at)].low, places[c, math.ceil(at)].low
            out[c].append(low + (high - low) * (at - math.floor(at)))
    return out


def _known(column: pa.Array) -> np.ndarray:
    """The values of a column of doubles that are neither null nor NaN."""
    x = column.to_numpy(zero_copy_only=False)
    return x[~np.isnan(x)]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, lowest and highest value of each column over the rows of a task."""
    found: dict[int, tuple[int, float, float]] = {}
    for batch in batches:
        for i, column in enumerate(batch.columns):
            if len(x := _known(column)):
                n, a, b = found.get(i, (0, math.inf, -math.inf))
                found[i] = n + len(x), min(a, x.min()), max(b, x.max())
    rows = [(i, int(n), float(a), float(b)) for i, (n, a, b) in found.items()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64())],
        names=["column", "n", "a", "b"],
    )


def _parts(x: np.ndarray, low: float, high: float, most: int) -> np.ndarray:
    """The part of the range in which each value lies; the highest value has one of its own."""
    half = (x / 2 - low / 2) / (high / 2 - low / 2)  # the width of a range may not fit into a double
    part = np.nan_to_num(np.floor(half * most)).astype(np.int64)
    return np.where(x == high, most, np.where(x == low, 0, part))


def _counted(values: DataFrame, columns: Sequence[str], ranges: list[tuple[str, float, float]]) -> dict:
    """For each range its parts that hold values, in order: number, lowest and highest value.

    A task counts its rows column by column, so that rows aren't multiplied by columns and ranges; what leaves it are counts.
    """
    used = sorted({columns.index(c) for c, _, _ in ranges})
    most = PARTS
    asked = [(i, used.index(columns.index(c)), low, high) for i, (c, low, high) in enumerate(ranges)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros((len(asked), most + 1), np.int64)
        lowest, highest = np.full(number.shape, np.inf), np.full(number.shape, -np.inf)
        for batch in batches:
            known = [_known(c) for c in batch.columns]
            for i, at, low, high in asked:
                x = known[at][(known[at] >= low) & (known[at] <= high)]
                if len(x):
                    part = _parts(x, low, high, most)
                    number[i] += np.bincount(part, minlength=most + 1)
                    np.minimum.at(lowest[i], part, x)
                    np.maximum.at(highest[i], part, x)
        at, part = np.nonzero(number)
        arrays = [at.astype(np.int32), part.astype(np.int32), number[at, part], lowest[at, part], highest[at, part]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["range", "part", "n", "a", "b"])

    tasks = values.select(*[f"c{i}" for i in used]).mapInArrow(count, "range int, part int, n long, a double, b double")
    found = tasks.groupBy("range", "part").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
    out: dict = {r: [] for r in ranges}
    for r in sorted(found.collect(), key=lambda r: (r["range"], r["part"])):
        out[ranges[r["range"]]].append((r["n"], r["a"], r["b"]))
    return out


@dataclass
class Scale:
    """Middle and width of some columns: the median and the distance of the quartiles, or 1 where that is 0."""

    middle: list[float]
    width: list[float]

    def scaled(self, x: Column, i: int = 0) -> Column:
        return (x - self.middle[i]) / self.width[i]

    def restored(self, x: Column, i: int = 0) -> Column:
        return x * self.width[i] + self.middle[i]


def fit_scale(df: DataFrame, columns: Sequence[str]) -> Scale:
    found = [q if not math.isnan(q[1]) else [0.0, 0.0, 0.0] for q in exact_quantiles(df, columns).values()]
    return Scale([q[1] for q in found], [(q[2] - q[0]) or 1.0 for q in found])


@dataclass
class Linear:
    """A linear model over some elements of a vector column; adds its prediction as the fitted models of MLlib do."""

    intercept: float
    weights: list[float]
    elements: list[int]
    features: str
    prediction: str

    def getPredictionCol(self) -> str:
        return self.prediction

    def copy(self) -> Linear:
        return Linear(self.intercept, self.weights, self.elements, self.features, self.prediction)

    def setFeaturesCol(self, name: str) -> Linear:
        self.features = name
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.features))
        total = F.lit(self.intercept)
        for weight, element in zip(self.weights, self.elements):
            total = total + x[element] * weight
        return df.withColumn(self.prediction, total)


def fit_linear(
    df: DataFrame, features: str, elements: Sequence[int], label: str, prediction: str, ridge: float = 0.0
) -> Linear:
    """Least squares on a few elements of a vector column, solved from one row of covariances; `ridge` is a share of the
    variance. Covariances are combined in each task. Elements without variance get no weight."""
    x = [vector_to_array(F.col(features))[i] for i in elements]
    known = df.where(F.col(label).isNotNull()).select(*[c.alias(f"x{i}") for i, c in enumerate(x)], F.col(label).alias("y"))
    names = [f"x{i}" for i in range(len(x))]
    pairs = [(a, b) for i, a in enumerate(names) for b in [*names[i:], "y"]]
    row = known.agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs], *[F.avg(c).alias(c) for c in [*names, "y"]]).first()
    if row["y"] is None:
        return Linear(0.0, [0.0] * len(names), list(elements), features, prediction)
    gram = np.zeros((len(names), len(names)))
    for a, b in pairs:
        if b != "y":
            i, j = names.index(a), names.index(b)
            gram[i, j] = gram[j, i] = row[f"{a}_{b}"]
    gram += ridge * np.diag(np.diag(gram))
    used = np.flatnonzero(np.diag(gram) > 0)
    weights = np.zeros(len(names))
    weights[used] = np.linalg.lstsq(gram[np.ix_(used, used)], np.array([row[f"x{i}_y"] for i in used]), rcond=None)[0]
    intercept = row["y"] - sum(w * row[c] for w, c in zip(weights, names))
    return Linear(float(intercept), [float(w) for w in weights], list(elements), features, prediction)


def binned(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The cell of each scaled value; `BINS` for null."""
    cell = np.clip(np.nan_to_num(np.floor(x * 2)) + BINS // 2, 0, BINS - 1).astype(np.int64)
    return np.where(known, cell, BINS)


@dataclass
class _Moments:
    """Numbers, means and sums of products of deviations of columns `x` and a label `y`. Those of two sets of rows merge, and
    a column that doesn't vary keeps a deviation of exactly 0."""

    n: np.ndarray
    x: np.ndarray
    y: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    @staticmethod
    def of(x: np.ndarray, known: np.ndarray, y: np.ndarray) -> _Moments:
        """Of the rows of each column of `x` where it is known."""
        n = known.sum(axis=0).astype(float)
        some = np.maximum(n, 1)

        def centred(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first = v[known.argmax(axis=0), np.arange(v.shape[1])]
            away = np.where(known, v - first, 0.0)
            mean = away.sum(axis=0) / some
            return np.where(n > 0, first + mean, 0.0), np.where(known, away - mean, 0.0)

        (mx, dx), (my, dy) = centred(x), centred(np.broadcast_to(y[:, None], x.shape))
        return _Moments(n, mx, my, (dx * dx).sum(axis=0), (dx * dy).sum(axis=0), (dy * dy).sum(axis=0))

    def merged(self, other: _Moments) -> _Moments:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        both, dx, dy = self.n * share, other.x - self.x, other.y - self.y
        return _Moments(
            n, self.x + dx * share, self.y + dy * share, self.xx + other.xx + dx * dx * both, self.xy + other.xy + dx * dy * both,
            self.yy + other.yy + dy * dy * both,
        )


MOMENTS = ["n", "x", "y", "xx", "xy", "yy"]


def lagged_ranks(rows: DataFrame, lookback: int, bounded: bool = False) -> DataFrame:
    """How well each element of a lookback vector tells the label: (lag, column, f, mi).

    `rows` has site_id, ts, x and y: scaled columns as an array, and a label where the row ends a lookback vector that counts.
    The element of a column k rows back goes with the label k rows ahead of the row that it is in. So each row is read once
    with `lookback` labels next to it, and no vectors are built: a task sums up its rows in one row for each lag and column,
    which are merged. `f` is the F statistic of the linear relation, `mi` the mutual information of both values in `BINS`
    cells. Both are 0 for columns that don't vary.
    """
    lags = range(lookback)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({f"y{k}": F.lead("y", k).over(w) for k in lags})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments: list[_Moments | None] = [None] * lookback
        label: _Moments | None = None
        counts = width = None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten()
            width = len(flat) // batch.num_rows
            v = flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(v.shape)
            cell = (np.arange(width) * (BINS + 1) + binned(v, known)) * BINS
            counts = np.zeros((lookback, width * (BINS + 1) * BINS), np.int64) if counts is None else counts
            for k in lags:
                at = np.flatnonzero(batch.column(k + 1).is_valid().to_numpy(zero_copy_only=False))
                y = batch.column(k + 1).to_numpy(zero_copy_only=False)[at]
                every = np.ones((len(at), 1), bool)
                found = _Moments.of(v[at], known[at], y) if len(at) else _Moments(*np.zeros((6, width)))
                moments[k] = found if moments[k] is None else moments[k].merged(found)
                if k == 0:
                    found = _Moments.of(y[:, None], every, y) if len(at) else _Moments(*np.zeros((6, 1)))
                    label = found if label is None else label.merged(found)
                counts[k] += np.bincount((cell[at] + binned(y, every[:, 0])[:, None]).ravel(), minlength=counts.shape[1])
        if counts is not None:
            cells = counts.reshape(lookback, width, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(lookback, dtype=np.int32), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), lookback)),
                    *[pa.array(np.concatenate([getattr(m, c) for m in moments])) for c in MOMENTS],
                    *[pa.array(np.repeat(getattr(label, c), lookback * width)) for c in ("n", "y", "yy")],
                    pa.array(cells.reshape(lookback * width, -1).tolist(), pa.list_(pa.int64())),
                ],
                names=["lag", "column", *MOMENTS, "label_n", "label_y", "label_yy", "cells"],
            )

    def ranked(parts: pd.DataFrame) -> pd.DataFrame:
        total, label = None, None
        for part in parts.itertuples(index=False):
            one = _Moments(*(np.array([getattr(part, c)]) for c in MOMENTS))
            own = _Moments(*(np.array([x]) for x in (part.label_n, 0.0, part.label_y, 0.0, 0.0, part.label_yy)))
            total, label = (one, own) if total is None else (total.merged(one), label.merged(own))
        spread = (total.xx / np.maximum(total.n, 1) * label.yy / np.maximum(label.n, 1))[0]
        both = (total.xy / np.maximum(total.n, 1))[0]
        square = 0.0 if spread <= 0 else both * both / spread
        f = square / (1 - square) * (label.n[0] - 2) if square < 1 else math.inf
        cells = np.sum(parts["cells"].tolist(), axis=0).reshape(BINS + 1, BINS).astype(float)
        at = np.nonzero(cells)
        n, in_bin, in_y = cells[at], cells.sum(axis=1)[at[0]], cells.sum(axis=0)[at[1]]
        mi = (n / cells.sum() * np.log(n * cells.sum() / (in_bin * in_y))).sum() if len(n) else 0.0
        return pd.DataFrame({"lag": parts["lag"][:1], "column": parts["column"][:1], "f": f, "mi": mi})

    find_package(rows.sparkSession)
    ahead = over_series(rows, build, after=lookback - 1, bounded=bounded).select("x", *[F.col(f"y{k}").cast("double") for k in lags])
    doubles = ", ".join(f"{c} double" for c in [*MOMENTS, "label_n", "label_y", "label_yy"])
    parts = ahead.mapInArrow(sums, f"lag int, column int, {doubles}, cells array<long>")
    return parts.groupBy("lag", "column").applyInPandas(ranked, "lag int, column int, f double, mi double")
