"""Bucket geometry on sizes worked out by hand."""

import pytest
from pixelloom.functions import geometry
from pyspark.sql import functions as F

# w, h, bucket, resized, trim offset, crop rectangle, time ids
CASES = [
    (1024, 1024, (1024, 1024), (1024, 1024), (0, 0), [0, 0, 1024, 1024], [1024, 1024, 0, 0, 1024, 1024]),
    (1920, 1080, (1344, 768), (1365, 768), (10, 0), [0, 6, 1344, 762], [1080, 1920, 6, 0, 768, 1344]),
    (1080, 1920, (768, 1344), (768, 1365), (0, 10), [6, 0, 762, 1344], [1920, 1080, 0, 6, 1344, 768]),
    (512, 768, (832, 1216), (832, 1248), (0, 16), [11, 0, 821, 1216], [768, 512, 0, 11, 1216, 832]),
    (3000, 500, (1536, 640), (3840, 640), (1152, 0), [0, 192, 1536, 448], [500, 3000, 192, 0, 640, 1536]),
    (1000, 999, (1024, 1024), (1025, 1024), (0, 0), [0, 1, 1024, 1023], [999, 1000, 1, 0, 1024, 1024]),
    (640, 480, (1152, 896), (1195, 896), (21, 0), [0, 16, 1152, 880], [480, 640, 16, 0, 896, 1152]),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([c[:2] for c in CASES], "w long, h long").withColumn("b", geometry.nearest_bucket(F.col("w"), F.col("h")))
    args = F.col("w"), F.col("h"), F.col("b.w"), F.col("b.h")
    rw, rh = geometry.cover_size(*args)
    x, y = geometry.trim_offsets(rw, rh, F.col("b.w"), F.col("b.h"))
    crop = geometry.fit_rectangle(*args)
    ids = geometry.time_ids(F.array("w", "h"), crop, F.array("b.w", "b.h"))
    return {(r.w, r.h): r for r in df.select("w", "h", "b", rw.alias("rw"), rh.alias("rh"), x.alias("x"), y.alias("y"), crop.alias("crop"), ids.alias("ids")).collect()}


@pytest.mark.parametrize("case", CASES, ids=lambda c: f"{c[0]}x{c[1]}")
def test_case(found, case):
    w, h, bucket, resized, trim, crop, ids = case
    r = found[w, h]
    assert (r.b.w, r.b.h) == bucket
    assert ((r.rw, r.rh) == resized) and ((r.x, r.y) == trim)
    assert r.crop == crop and r.ids == ids


def test_nearest_is_nearest(spark):
    rows = spark.range(2000).select((1 + F.col("id") * 37 % 1999).alias("w"), (1 + F.col("id") * 91 % 1777).alias("h")).withColumn("b", geometry.nearest_bucket(F.col("w"), F.col("h"))).collect()
    for r in rows:
        assert abs(r.b.w / r.b.h - r.w / r.h) == min(abs(a / b - r.w / r.h) for a, b in geometry.BUCKETS)
