"""Hard negatives against all pairs in plain Python, and the planes against plain products."""

import math
import random

import numpy as np
import pytest
from helpers import clashing
from pixelloom.llm import hard_negatives as m
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, low=m.LOW, high=m.HIGH, positives=m.POSITIVES, negatives=m.NEGATIVES):
    """Results of rows (id, vector, label), all with ids of their own or null; anchors have ids divisible by 10."""
    taking = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, v, lab) in enumerate(taking):
        if i is None or i % 10:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j is None, j or 0, j, other) for n, (j, w, other) in enumerate(taking) if n != k]
        scored.sort(key=lambda x: (-x[0], x[1], x[2]))
        for p in [x for x in scored if x[4] == lab][:positives]:
            hard = [x for x in scored if x[4] != lab and low * p[0] <= 100 * x[0] <= high * p[0]][:negatives]
            out += [(i, p[3], r + 1, x[3], p[0], x[0]) for r, x in enumerate(hard)]
    return sorted(out, key=repr)


def mined(spark, df):
    return sorted((tuple(r) for r in m.mine(m.whole_numbers(df, "vec_id", "label", "embedding"), F.col("id") % 10 == 0).collect()), key=repr)


def vectors(seed, n, width=8, labels=3, hot=0):
    rng = random.Random(seed)
    one = [round(rng.uniform(0.1, 1), 3) for _ in range(width)]
    return [(k, [float(np.float32(x)) for x in (one if rng.random() < hot else [rng.uniform(-1, 1) for _ in range(width)])], 0 if rng.random() < 0.4 else rng.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize(("seed", "hot"), [(1, 0), (2, 0.4)])
def test_against_all_pairs(spark, monkeypatch, seed, hot):
    for name, value in (("LEAST", 64), ("TILE", 16), ("BATCH", 7), ("SPARSE", 4)):
        monkeypatch.setattr(m, name, value)
    rows = vectors(seed, 400, hot=hot)
    assert mined(spark, spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (10, [0.5, -0.25], 1), (20, [], 1), (3, [1.0, 0.5, 0.25], 1), (4, [1.0], 2), (5, [0.75, 0.25], 2), (6, [0.6, nan], 2), (7, [inf, 0.1], 2),
        (8, None, 1), (9, [0.5, None], 2), (30, [0.5, 0.5], None), (None, [0.8, 0.3], 2), (None, [0.9, 0.5], 1), (40, [-0.0, 0.0], 2), (11, [0.3, 0.1], 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rows)
    assert expected and mined(spark, df) == expected
    assert mined(spark, clashing(df).withColumn("parts", F.lit(1)).withColumn("g", F.lit("x"))) == expected


def test_equal_rows_and_ids(spark):
    """Copies count each; anchors with one id each have their results, and equal rows are positives of each other."""
    rows = [(10, [1.0, 0.0], 1), (10, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2)]
    assert mined(spark, spark.createDataFrame(rows, SCHEMA)) == [(10, 10, r, 2, 65536, 32768) for r in (1, 1, 2, 2)]


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(spark, empty) == []
    assert mined(spark, spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], SCHEMA)) == []
    assert mined(spark, spark.createDataFrame([(0, [1.0], 1), (2, [1.0], 2)], SCHEMA)) == []


def test_large_components(spark):
    rows = [(0, [30000.0, -2.0], 1), (1, [20000.0, 1.0], 1), (2, [9000.0, 3.0], 2)]
    assert mined(spark, spark.createDataFrame(rows, SCHEMA)) == brute(rows) != []
    with pytest.raises(Exception, match="24 bits"):
        mined(spark, spark.createDataFrame([(0, [1e30], 1)], SCHEMA))


@pytest.mark.parametrize("seed", range(4))
def test_planes(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    rows, anchors = rng.integers(-300, 300, (50, 9)).astype(np.int32), rng.integers(-300, 300, (12, 9)).astype(np.int32)
    mask, low, high = rng.random((12, 50)) < 0.7, rng.integers(-200_000, 100_000, 12), rng.integers(0, 400_000, 12)
    scores = anchors.astype(np.int64) @ rows.T
    expected = {(a, r, scores[a, r]) for a, r in zip(*np.nonzero(mask & (scores >= low[:, None]) & (scores <= high[:, None])), strict=True)}
    for sparse in (1, 3, 10**9):
        monkeypatch.setattr(m, "SPARSE", sparse)
        assert set(zip(*m.bounded(rows, anchors, 9, mask, low, high), strict=True)) == expected
