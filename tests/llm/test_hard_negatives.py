import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.llm import hard_negatives as hn, oracle, queries

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def plain(rows, positives=5, negatives=3):
    """All results by comparing every anchor with every row."""
    usable = []
    for id, vector, label in rows:
        if id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if id % 7 == 0 else label
        usable.append((id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for i, (id, v, label) in enumerate(usable):
        if id % 50:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), other, j, kind) for j, (other, w, kind) in enumerate(usable) if j != i and len(w) == len(v)
        )
        for s, positive, _, _ in [x for x in scored if x[3] == label][:positives]:
            inside = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(id, positive, k + 1, x[1], -s, -x[0]) for k, x in enumerate(inside[:negatives])]
    return sorted(out)


def rows_of(count, seed, dimension=12, labels=3):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.2, (count, dimension)) + 0.2
    return [(i, vectors[i].astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(count)]


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hn.hard_negatives(df, F.col("vec_id") % 50 == 0, label)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


@pytest.mark.parametrize("blocks", [(1024, 4096), (2, 37)])
def test_equals_plain(spark, monkeypatch, blocks):
    monkeypatch.setattr(hn, "ANCHORS_PER_BLOCK", blocks[0])
    monkeypatch.setattr(hn, "CANDIDATES_PER_BLOCK", blocks[1])
    monkeypatch.setattr(hn, "MERGED_CELLS", 2)
    rows = rows_of(330, 1)
    tied = rows[7][1]
    rows += [(1000 + i, tied, 1) for i in range(6)] + [(50, rows[50][1], rows[50][2]), (50, rows[3][1], 0), (51, rows[51][1], 2)]
    rows += [
        (None, tied, 1), (400, None, 1), (401, tied, None), (402, [None] * 12, 1), (403, [float("nan")] * 12, 1), (404, [float("inf")] * 12, 1),
        (450, [0.5, 0.5], 1), (451, [0.5, 0.25], 1), (452, [0.25, 0.5], 2), (500, [], 1), (501, [], 1), (502, [], 2), (550, [-1.0] * 12, 1),
    ]
    want = plain(rows)
    assert len(want) > 60 and mined(spark, rows) == want


def test_empty_and_alone(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [0.5], 1)]) == []
    assert mined(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []


def test_large_values(spark):
    rows = [(0, [2.0**20, 2.0**20], 0), (1, [2.0**20, 0.0], 1), (2, [2.0**19, 2.0**18], 2)]
    assert mined(spark, rows) == plain(rows) != []
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, [2.0**40], 0), (1, [2.0**40], 1), (2, [2.0**39], 2)])


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 3, 7), (64, 64, 64), (65, 33, 129), (2, 200, 3)])
def test_strassen(shape):
    rng = np.random.default_rng(sum(shape))
    a, b = rng.integers(-(2**20), 2**20, shape[:2]), rng.integers(-(2**20), 2**20, shape[1:])
    assert np.array_equal(hn.strassen(a, b, direct=2), a @ b)
    high = a.astype(object) * 2**80
    assert np.array_equal(hn.strassen(high, b.astype(object), direct=4), high @ b.astype(object))


def test_query_equals_plain(spark, tmp_path):
    rows = rows_of(160, 4)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows)
    assert "op12_hard_negatives" in oracle.SQL
