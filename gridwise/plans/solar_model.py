"""Solar forecast with fitted models: scale, look back 12 rows, stack base models, select, one model per hour.

Everything is fitted on all sites together. The feature table is kept once and read by each fit. A lookback vector has 924
elements. The base models and the trees whose importance selects look at all of them; these vectors are built anew in each
pass over the kept rows and never stored. The models of the hours look at what is selected.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler, VectorSizeHint, VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, WindowSpec, functions as F

from gridwise.functions.scalars import add_hours
from gridwise.operators.forecasts import SOLAR_HORIZON, solar_energy
from gridwise.operators.series import last_n_rows, micros, over_series
from gridwise.operators.solar_features import all_lookbacks, last_lookback, scoring_readings, solar_features
from gridwise.operators.statistics import Scale, exact_quantiles, fit_linear, fit_scale, lagged_ranks
from gridwise.operators.validate import LOOKBACK, fill_missing_features, MIN_READINGS_EFFECTIVE, min_rows, missing_sensor, require_complete
from gridwise.schemas import FEATURES, SITE
from gridwise.sources.models import load_models, save_models

# Elements kept by each of the three selection tests.
TOP_PER_TEST = 32
SEED = 7
WIDTH = LOOKBACK * len(FEATURES)


@dataclass
class SolarModels:
    scale: Scale
    target: Scale
    horizons: list[Model]
    bases: list[Model] = field(default_factory=list)
    # Places in the lookback vector with one prediction per base model appended that the horizons use; None for all.
    selected: list[int] | None = None
    # Places in the lookback vector that the base models look at, in order; None for all.
    inputs: list[int] | None = None
    # Names in the order in which the models were fitted.
    features: list[str] = field(default_factory=lambda: list(FEATURES))

    @property
    def elements(self) -> list[int] | None:
        """Places in the lookback vector that the horizons use next to predictions; None for all."""
        return None if self.selected is None else [p for p in self.selected if p < WIDTH]

    def save(self, spark: SparkSession, folder: str) -> None:
        parts = {f"base_{i}": m for i, m in enumerate(self.bases)}
        parts.update({f"hour_{h}": m for h, m in enumerate(self.horizons, 1)})
        values = {"selected": self.selected, "inputs": self.inputs, "features": self.features}
        save_models(spark, folder, parts, {**values, "scale": asdict(self.scale), "target": asdict(self.target)})


def load_solar_models(spark: SparkSession, folder: str) -> SolarModels:
    """Base models and the selection are optional."""
    parts, values = load_models(spark, folder)
    bases = [parts[k] for k in sorted(k for k in parts if k.startswith("base_"))]
    horizons = [parts[f"hour_{h}"] for h in range(1, SOLAR_HORIZON + 1)]
    scale, target = Scale(**values["scale"]), Scale(**values["target"])
    # Earlier models were stored with the places that base models look at under another name.
    inputs = values["inputs"] if "inputs" in values else values["elements"]
    return SolarModels(scale, target, horizons, bases, values["selected"], inputs, values["features"])


def place(feature: str, lag: int = 0, names: list[str] = FEATURES) -> int:
    """The place of a feature `lag` rows back in a lookback vector, whose oldest row comes first."""
    return (LOOKBACK - 1 - lag) * len(names) + names.index(feature)


def scale_features(features: DataFrame, scale: Scale, names: list[str] = FEATURES) -> DataFrame:
    """(site_id, ts, GHI, x) with x the scaled features as an array."""
    return features.select(SITE, "ts", "GHI", F.array(*[scale.scaled(F.col(c), i) for i, c in enumerate(names)]).alias("x"))


def fit_scales(features: DataFrame) -> tuple[Scale, Scale]:
    """The scales of the features and of the irradiance."""
    both = fit_scale(features, [*FEATURES, "GHI"])
    return Scale(both.middle[:-1], both.width[:-1]), Scale(both.middle[-1:], both.width[-1:])


def scale_target(windows: DataFrame, target: Scale) -> DataFrame:
    """`label_h` for each hour, in the scale the models are fitted on."""
    return windows.withColumns({f"label_{h}": target.scaled(F.col(f"y{h}")) for h in range(1, SOLAR_HORIZON + 1)})


def stack_meta(df: DataFrame, bases: list[Model], size: int = WIDTH) -> DataFrame:
    """`stacked`: the vector `features`, which has `size` elements, with one prediction per base model appended."""
    if not bases:
        return df.withColumnRenamed("features", "stacked")
    # Without a size the assembler runs a job for the first row.
    df = VectorSizeHint(inputCol="features", size=size, handleInvalid="optimistic").transform(df)
    for model in bases:
        df = model.transform(df)
    meta = [model.getPredictionCol() for model in bases]
    stacked = VectorAssembler(inputCols=["features", *meta], outputCol="stacked").transform(df)
    return stacked.drop("features", *meta)


def hstack_select(df: DataFrame, selected: list[int] | None, elements: list[int] | None = None) -> DataFrame:
    """`chosen`: the `selected` places of the whole stacked vector, of which `stacked` has the `elements` and what was
    appended."""
    if selected is None:
        return df.withColumnRenamed("stacked", "chosen")
    at = selected
    if elements is not None:
        held = {e: i for i, e in enumerate(elements)}
        at = [held[p] if p < WIDTH else len(elements) + p - WIDTH for p in selected]
    return VectorSlicer(inputCol="stacked", outputCol="chosen", indices=at).transform(df).drop("stacked")


def fit_bases(train: DataFrame) -> list[Model]:
    """Two forests of different depth, a ridge and a lasso. The linear ones need one pass over the data."""
    common = {"featuresCol": "features", "labelCol": "label_1"}
    forest = {**common, "numTrees": 8, "maxBins": 16, "subsamplingRate": 0.7}
    linear = {**common, "solver": "normal", "regParam": 0.1}
    estimators = [
        RandomForestRegressor(**forest, maxDepth=4, seed=SEED, predictionCol="meta_forest"),
        RandomForestRegressor(**forest, maxDepth=6, seed=SEED + 1, predictionCol="meta_deep_forest"),
        LinearRegression(**linear, elasticNetParam=0.0, predictionCol="meta_ridge"),
        LinearRegression(**linear, elasticNetParam=1.0, predictionCol="meta_lasso"),
    ]
    return [e.fit(train) for e in estimators]


def element_ranks(rows: DataFrame, target: Scale) -> DataFrame:
    """(lag, column, f, mi) of every element of the lookback vectors that models are fitted on, for the next hour."""

    def label(df: DataFrame, w: WindowSpec) -> DataFrame:
        whole = F.lag("ts", LOOKBACK - 1).over(w).isNotNull() & F.lead("GHI", SOLAR_HORIZON).over(w).isNotNull()
        return df.withColumn("y", F.when(whole, target.scaled(F.lead("GHI", 1).over(w))))

    return lagged_ranks(over_series(rows, label, LOOKBACK - 1, SOLAR_HORIZON), LOOKBACK)


def best_elements(ranks: DataFrame, test: str, most: int) -> list[int]:
    """The places of the `most` best elements; ties go to the latest row, then to the first column."""
    best = ranks.orderBy(F.desc(test), "lag", "column").limit(most).collect()
    return [(LOOKBACK - 1 - r["lag"]) * len(FEATURES) + r["column"] for r in best]


def select_features(train: DataFrame, by_f: list[int], by_mi: list[int], metas: int) -> list[int]:
    """Union of the best elements by F-test, by mutual information and by boosted-tree importance among all of them, and all
    predictions of base models. `train` has whole stacked vectors."""
    trees = GBTRegressor(featuresCol="stacked", labelCol="label_1", maxIter=4, maxDepth=3, maxBins=16, seed=SEED).fit(train)
    weights = trees.featureImportances
    by_tree = [int(i) for i in weights.indices[weights.values.argsort()[::-1]][:TOP_PER_TEST]]
    return sorted({*by_f, *by_mi, *by_tree, *range(WIDTH, WIDTH + metas)})


def training_windows(rows: DataFrame, target: Scale, elements: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chosen elements of all lookback vectors as `features`, with labels: all of them, kept until they are unpersisted,
    the earlier half of the times and the later."""
    windows = scale_target(all_lookbacks(rows, SOLAR_HORIZON, elements=elements), target)
    windows = windows.withColumn("features", array_to_vector("lookback")).drop("lookback").persist(StorageLevel.MEMORY_AND_DISK)
    middle = exact_quantiles(windows.select(micros("ts").cast("double").alias("ts")), ["ts"], [0.5])["ts"][0]
    return windows, windows.where(micros("ts") <= middle), windows.where(micros("ts") > middle)


def whole_windows(rows: DataFrame, target: Scale) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole lookback vectors as `features`, with labels: the kept rows behind them, which are to be unpersisted, the vectors
    in the earlier half of the times and those in the later.

    A row is kept with its own elements, in its place in the series; its vector is twelve of them and only lives in a pass.
    """
    held: list[DataFrame] = []

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        ahead = {f"y{h}": F.lead("GHI", h).over(w) for h in range(1, SOLAR_HORIZON + 1)}
        held.append(df.withColumns(ahead).persist(StorageLevel.MEMORY_AND_DISK))
        past = F.flatten(F.collect_list("x").over(w.rowsBetween(-(LOOKBACK - 1), 0)))
        return held[0].withColumns({"lookback": past, "oldest": F.lag("ts", LOOKBACK - 1).over(w)})

    built = over_series(rows.select(SITE, "ts", "GHI", "x"), build, LOOKBACK - 1, SOLAR_HORIZON)
    full = built.where(F.col("oldest").isNotNull() & F.col(f"y{SOLAR_HORIZON}").isNotNull())
    labelled = scale_target(full, target).withColumn("features", array_to_vector("lookback"))
    windows = labelled.select(SITE, "ts", "features", *[f"label_{h}" for h in range(1, SOLAR_HORIZON + 1)])
    middle = exact_quantiles(full.select(micros("ts").cast("double").alias("ts")), ["ts"], [0.5])["ts"][0]
    return held[0], windows.where(micros("ts") <= middle), windows.where(micros("ts") > middle)


def fit_solar(features: DataFrame) -> SolarModels:
    """Fit on a feature table. Base models see the earlier half of the time range, the rest the later half."""
    scale, target = fit_scales(features)
    rows = scale_features(features, scale)
    ranks = element_ranks(rows, target).persist()
    by_f, by_mi = (best_elements(ranks, test, TOP_PER_TEST) for test in ("f", "mi"))
    ranks.unpersist()
    held, early, late = whole_windows(rows, target)

    bases = fit_bases(early)
    stacked = stack_meta(late, bases)
    selected = select_features(stacked, by_f, by_mi, len(bases))
    chosen = hstack_select(stacked, selected).persist(StorageLevel.MEMORY_AND_DISK)
    horizons = [
        GBTRegressor(
            featuresCol="chosen", labelCol=f"label_{h}", predictionCol=f"hour_{h}", maxIter=8, maxDepth=3, maxBins=16, seed=SEED
        ).fit(chosen)
        for h in range(1, SOLAR_HORIZON + 1)
    ]
    chosen.unpersist()
    held.unpersist()
    return SolarModels(scale, target, horizons, bases, selected)


def fit_linear_solar(features: DataFrame, bases: list[int], selected: list[int]) -> SolarModels:
    """The same stack in closed form: a line on each of some elements as base models, least squares on the selected places
    of the stacked vector for each hour."""
    scale, target = fit_scales(features)
    elements = sorted({*bases, *(p for p in selected if p < WIDTH)})
    windows, early, late = training_windows(scale_features(features, scale), target, elements)
    lines = [fit_linear(early, "features", [elements.index(p)], "label_1", f"meta_{p}") for p in bases]
    chosen = hstack_select(stack_meta(late, lines, len(elements)), selected, elements)
    every = list(range(len(selected)))
    horizons = [fit_linear(chosen, "chosen", every, f"label_{h}", f"hour_{h}") for h in range(1, SOLAR_HORIZON + 1)]
    windows.unpersist()
    return SolarModels(scale, target, horizons, lines, selected, elements)


def last_chosen(features: DataFrame, models: SolarModels, bounded: bool = False) -> DataFrame:
    """(site_id, last_ts, chosen): what the horizons look at for the last row of each site with a full lookback. `bounded` says
    that sites are known to be short, as those of `scoring_readings`."""
    # The few rows that are scored are cut out before they are scaled. They have the columns that the models know.
    recent = last_n_rows(fill_missing_features(features, models.features, [SITE, "ts", "GHI"]), LOOKBACK, bounded)
    last = last_lookback(scale_features(recent, models.scale, models.features), bounded=True)
    held = F.col("lookback") if models.inputs is None else F.array(*[F.col("lookback")[p] for p in models.inputs])
    vectors = last.withColumn("features", array_to_vector(held)).drop("lookback")
    size = len(models.features) * LOOKBACK if models.inputs is None else len(models.inputs)
    return hstack_select(stack_meta(vectors, models.bases, size), models.selected, models.inputs)


def solar_direct_3h(features: DataFrame, models: SolarModels, bounded: bool = False) -> DataFrame:
    """(site_id, step, ts, ghi) for the three hours after the last row of each site."""
    scored = last_chosen(features, models, bounded)
    for model in models.horizons:
        scored = model.transform(scored)
    predicted = F.array(*[F.greatest(models.target.restored(F.col(model.getPredictionCol())), F.lit(0.0)) for model in models.horizons])
    steps = scored.select(SITE, "last_ts", F.posexplode(predicted).alias("pos", "ghi"))
    step = (F.col("pos") + 1).cast("int")
    return steps.select(SITE, step.alias("step"), add_hours("last_ts", step).alias("ts"), "ghi")


def solar_rejected(readings: DataFrame) -> DataFrame:
    """Sites without a solar forecast: site_id, n, reason. Readings that lack a sensor don't count."""
    counted = readings.select(SITE, F.when(missing_sensor(), 0).otherwise(1).alias("complete"))
    counts = counted.groupBy(SITE).agg(F.sum("complete").alias("n"))
    return counts.where(F.col("n") < MIN_READINGS_EFFECTIVE).withColumn("reason", F.lit("too few rows"))


def solar_3h(readings: DataFrame, panels: DataFrame) -> DataFrame:
    """Fit on all readings and forecast every site with enough of them; `solar_rejected` has the others.

    The feature table is kept while models are fitted; scoring builds the few rows that it needs anew.
    """
    accepted, _ = min_rows(require_complete(readings), MIN_READINGS_EFFECTIVE)
    features = solar_features(accepted).persist(StorageLevel.MEMORY_AND_DISK)
    models = fit_solar(features)
    features.unpersist()
    recent = solar_features(scoring_readings(accepted), bounded=True)
    return solar_energy(solar_direct_3h(recent, models, bounded=True), panels)
