"""Batches are of one bucket, cover every item once, and can be resumed."""

from collections import Counter, defaultdict

import pytest
from pixelloom.operators import buckets, numbering, prompts, sampler
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def items(spark):
    # Bucket sizes 1, 7, 8, 9 and 25 for batches of 8.
    rows, key = [], 0
    for b, n in enumerate((1, 7, 8, 9, 25)):
        rows += [(key + k, 100 + b, 200) for k in range(n)]
        key += n
    return spark.createDataFrame(rows, "key long, w long, h long")


def test_cover_and_purity(items):
    plan = sampler.plan_batches(items).collect()
    assert sorted(r.key for r in plan) == list(range(50))
    by = defaultdict(list)
    for r in plan:
        by[r.batch_ord].append(r)
    assert sorted(by) == list(range(len(by)))
    short = Counter()
    for rows in by.values():
        assert len({(r.w, r.h) for r in rows}) == 1
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        short[rows[0].w] += len(rows) < 8
    assert max(short.values()) <= 1
    assert len(by) == 1 + 1 + 1 + 2 + 4


def test_epochs_differ_and_repeat(items):
    order = lambda e: {r.key: (r.batch_ord, r.slot) for r in sampler.plan_batches(items, epoch=e).collect()}
    assert order(0) == order(0) != order(1)


def test_resume(items):
    plan = sampler.plan_batches(items)
    left = sampler.resume(plan, global_step=11, steps_per_epoch=4, accumulation=2)
    assert {r.batch_ord for r in left.collect()} == {6, 7, 8}


def test_in_order(items):
    plan = sampler.plan_in_order(items, position="key").collect()
    assert [(r.batch_ord, r.slot) for r in sorted(plan, key=lambda r: r.key)] == sorted((r.batch_ord, r.slot) for r in plan)


def test_numbers_without_groups(spark):
    df = spark.range(5000).withColumn("d", F.md5(F.col("id").cast("string")))
    rows = sorted(numbering.numbered(df, [], "d", "id", "n").collect(), key=lambda r: (r.d, r.id))
    assert [r.n for r in rows] == list(range(1, 5001))


def test_index_lookup(items):
    sizes = buckets.inventory(items.withColumn("bucket", F.struct("w", "h")))
    found = buckets.locate(items.select(F.col("key").alias("idx")), sizes).collect()
    assert len(found) == 50
    assert {(r.idx, r.w, r.place) for r in found} >= {(0, 100, 0), (1, 101, 0), (7, 101, 6), (8, 102, 0), (49, 104, 24)}


@pytest.mark.parametrize("p", [0.0, 0.1, 1.0])
def test_dropout_rates(spark, p):
    df = spark.range(4000).select(F.col("id"), F.array(*[F.lit(f"t{k}") for k in range(10)]).alias("t"))
    kept = df.select(F.size(prompts.drop_tags(F.col("t"), F.col("id"), 0.0, p, 1)).alias("n"), prompts.drop_caption(F.lit("c"), F.col("id"), p, 1).alias("c")).agg(F.avg("n"), F.avg((F.col("c") == "c").cast("int"))).first()
    assert abs(kept[0] / 10 - (1 - p)) < 4 * (p * (1 - p) / 40000) ** 0.5 + 1e-9
    assert abs(kept[1] - (1 - p)) < 4 * (p * (1 - p) / 4000) ** 0.5 + 1e-9


def test_shuffle_keeps_tags(spark):
    df = spark.range(50).select(F.col("id"), F.array(*[F.lit(f"t{k}") for k in range(10)]).alias("t"))
    rows = [r.s for r in df.select(prompts.shuffle_tags(F.col("t"), F.col("id"), 3).alias("s")).collect()]
    assert all(sorted(s) == sorted(f"t{k}" for k in range(10)) for s in rows) and len(set(map(tuple, rows))) > 40
    empty = spark.createDataFrame([(1, [])], "id long, t array<string>").select(prompts.augmented(F.lit(""), F.col("t"), F.col("id"), caption_p=0.5, all_tags_p=0.5, tag_p=0.5, condition_p=0, shuffle=True, seed=1).alias("p")).first()
    assert empty.p == ""
