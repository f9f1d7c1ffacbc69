"""The manifest: latents joined with their tags and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import _BLANK, listed_tags, parse_tags


def build(latents: DataFrame, tags: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """Manifest rows of ``latents`` (key, train_resolution, original_size, crop_ltrb) with tag texts and captions by key."""
    out = latents.join(tags.select("key", F.col("text").alias("__tags")), "key", "left")
    if captions is not None:
        out = out.join(captions.select("key", F.col("text").alias("caption")), "key", "left")
    else:
        out = out.withColumn("caption", F.lit(None).cast("string"))
    return out.select("key", parse_tags(F.col("__tags")).alias("tags"), "train_resolution", "original_size", "crop_ltrb", "caption")


def first_existing(candidates: DataFrame, key: str = "key", priority: str = "prio", value: str = "text") -> DataFrame:
    """Of several places for a key, the existing one that is looked up first."""
    return candidates.groupBy(key).agg(F.min_by(value, priority).alias(value), F.min(priority).alias(priority))


def missing(items: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Items whose key has no finished output."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def valid_tags(outputs: DataFrame, text: str = "text") -> DataFrame:
    """Outputs whose tag text isn't blank."""
    return outputs.where(F.btrim(F.col(text), F.lit(_BLANK)) != "")


def from_metadata(metadata: DataFrame, latents: DataFrame) -> DataFrame:
    """Legacy metadata (key, tags, caption) of keys that have latents; missing tags and captions become empty."""
    return latents.join(metadata, "key").select("key", listed_tags(F.col("tags")).alias("tags"), F.coalesce("caption", F.lit("")).alias("caption"), "train_resolution")


def dedupe(items: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: its first item by ``order``, and how many there were."""
    return items.groupBy(key).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))
