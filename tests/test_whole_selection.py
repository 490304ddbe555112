"""The solar fit looks at every element of the lookback vectors, not only at those that single tests rank best."""

import datetime as dt
import math

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor

from gridwise.operators.solar_features import all_lookbacks, solar_features
from gridwise.operators.statistics import exact_quantiles
from gridwise.operators.series import micros
from gridwise.plans import solar_model as sm
from gridwise.schemas import READINGS, SITE


@pytest.fixture(scope="module")
def fitted(spark):
    rows = []
    for site in (1, 2, 3):
        for i in range(24 * 6):
            ts = dt.datetime(2024, 6, 1) + dt.timedelta(hours=i)
            cloud = 0.3 + 0.2 * math.cos(0.9 * i + site)
            ghi = (400.0 + 90 * site) * max(0.0, math.sin(math.pi * (ts.hour - 5) / 14)) * (1 - cloud)
            rows.append((site, ts, ghi, ghi * 0.7, ghi * cloud, 12.0 + ghi / 90, 80.0 - ghi / 30, 2.0 + cloud, 4.0, (40.0 * site + i) % 360, 20.0, 990.0 + math.sin(i / 9)))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sm, "TOP_PER_TEST", 2)
        features = solar_features(spark.createDataFrame(rows, READINGS)).cache()
        yield features, sm.fit_solar(features)


def test_base_models_see_all_elements(fitted):
    assert [m.numFeatures for m in fitted[1].bases] == [sm.WIDTH] * 4 and fitted[1].inputs is None


def test_importance_chooses_among_all_elements(fitted):
    features, models = fitted
    rows = sm.scale_features(features, models.scale)
    windows = sm.scale_target(all_lookbacks(rows, 3), models.target).withColumn("features", array_to_vector("lookback"))
    middle = exact_quantiles(windows.select(micros("ts").cast("double").alias("ts")), ["ts"], [0.5])["ts"][0]
    late = windows.where(micros("ts") > middle)
    for model in models.bases:
        late = model.transform(late)
    names = ["features", *[m.getPredictionCol() for m in models.bases]]
    train = VectorAssembler(inputCols=names, outputCol="stacked").transform(late).orderBy(SITE, "ts").cache()
    assert train.first()["stacked"].size == sm.WIDTH + 4
    ranks = sm.element_ranks(rows, models.target).cache()
    by_f, by_mi = (sm.best_elements(ranks, test, 2) for test in ("f", "mi"))
    weights = GBTRegressor(featuresCol="stacked", labelCol="label_1", maxIter=4, maxDepth=3, maxBins=16, seed=sm.SEED).fit(train).featureImportances
    # Rows in another order may split ties otherwise, so only the clearly best is asked for.
    assert {*by_f, *by_mi, int(weights.indices[weights.values.argmax()])} <= set(models.selected)


def test_select_features_takes_any_element(spark):
    from pyspark.ml.linalg import Vectors

    far = 5
    rows = []
    for i in range(200):
        x = [0.0] * (sm.WIDTH + 1)
        x[far], x[sm.WIDTH] = float(i % 17), 1.0
        rows.append((Vectors.dense(x), float((i % 17 - 8) ** 2)))
    train = spark.createDataFrame(rows, ["stacked", "label_1"])
    # Neither test names the element; the trees do.
    assert sm.select_features(train, [1], [2], 1) == [1, 2, far, sm.WIDTH]


def test_models_stored_earlier_load(spark, fitted, tmp_path):
    from gridwise.sources.models import load_models, save_models

    models = fitted[1]
    models.save(spark, str(tmp_path / "now"))
    parts, values = load_models(spark, str(tmp_path / "now"))
    assert sm.load_solar_models(spark, str(tmp_path / "now")).inputs is None
    values.pop("inputs")
    save_models(spark, str(tmp_path / "then"), parts, {**values, "elements": [3, 4]})
    assert sm.load_solar_models(spark, str(tmp_path / "then")).inputs == [3, 4]
