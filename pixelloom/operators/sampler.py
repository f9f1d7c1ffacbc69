"""Bucket-pure batches in a shuffled order that any epoch can replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import digest
from .numbering import numbered, numbered_in_order

SEED = 47


def plan_batches(items: DataFrame, key: str = "key", batch_size: int = 8, epoch: int = 0, seed: int = SEED) -> DataFrame:
    """key, w, h, batch (within the bucket, from 0), batch_ord (over all, from 0) and slot of every item.

    ``items`` has w, h and a unique ``key``. Items are shuffled within their
    bucket and cut into batches, the last one short; then batches are shuffled.
    """
    drawn = items.select(key, "w", "h").withColumn("__d", digest(seed, epoch, F.col(key)))
    placed = numbered(drawn, ["w", "h"], "__d", key, "rn")
    batched = placed.withColumn("batch", F.floor((F.col("rn") - 1) / batch_size).cast("long")).withColumn("slot", ((F.col("rn") - 1) % batch_size).cast("long"))
    batches = batched.where("slot = 0").select("w", "h", "batch").withColumn("__b", digest(seed, epoch, F.concat_ws("x", "w", "h"), F.col("batch")))
    ordered = numbered(batches.withColumn("__t", F.struct("w", "h", "batch")), [], "__b", "__t", "ord").select("w", "h", "batch", (F.col("ord") - 1).alias("batch_ord"))
    return batched.join(ordered, ["w", "h", "batch"]).select(key, "w", "h", "batch", "batch_ord", "slot")


def plan_in_order(items: DataFrame, key: str = "key", position: str = "position", batch_size: int = 8) -> DataFrame:
    """Batches without shuffling: buckets by their first item, items by ``position``."""
    from pyspark.sql import Window as W

    first = items.groupBy("w", "h").agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum(F.ceil(F.col("n") / batch_size)).over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = first.withColumn("batches_before", before).drop("n", "first")
    placed = numbered_in_order(items, ["w", "h"], [position], "rn").withColumn("rn", F.col("rn") - 1)
    return placed.join(starts, ["w", "h"]).select(key, "w", "h", (F.floor(F.col("rn") / batch_size) + F.col("batches_before")).cast("long").alias("batch_ord"), (F.col("rn") % batch_size).cast("long").alias("slot"))


def batch_rows(plan: DataFrame, key: str = "key") -> DataFrame:
    """One row per batch with its keys in slot order."""
    members = F.sort_array(F.collect_list(F.struct("slot", key)))
    return plan.groupBy("batch_ord", "w", "h").agg(members.alias("m")).select("batch_ord", "w", "h", F.col(f"m.{key}").alias("keys"))


def resume(plan: DataFrame, global_step: int, steps_per_epoch: int, accumulation: int) -> DataFrame:
    """The batches of an epoch that a run stopped at ``global_step`` has yet to see."""
    done = (global_step % steps_per_epoch) * accumulation
    return plan.where(F.col("batch_ord") >= done)


def split_work(batches: DataFrame, workers: int, position: str = "batch_ord") -> DataFrame:
    """Batches dealt to workers in turn."""
    return batches.withColumn("worker", (F.col(position) % workers).cast("long"))
