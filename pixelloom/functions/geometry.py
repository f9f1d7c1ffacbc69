"""Resolution buckets, resizing and crop rectangles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket sizes (width, height) by ascending aspect ratio.
BUCKETS = (
    (640, 1536),
    (768, 1344),
    (832, 1216),
    (896, 1152),
    (1024, 1024),
    (1152, 896),
    (1216, 832),
    (1344, 768),
    (1536, 640),
)


def nearest_bucket(w: Column, h: Column, buckets=BUCKETS) -> Column:
    """struct(w, h) of the bucket whose aspect ratio is nearest; the earlier one on ties.

    The candidates are literals of the expression, so rows are neither joined nor multiplied.
    """
    ratio = w.cast("double") / h.cast("double")
    ways = [F.struct(F.abs(F.lit(bw / bh) - ratio).alias("gap"), F.lit(k).alias("k"), F.lit(bw).cast("long").alias("w"), F.lit(bh).cast("long").alias("h")) for k, (bw, bh) in enumerate(buckets)]
    best = F.array_min(F.array(*ways))
    return F.struct(best["w"].alias("w"), best["h"].alias("h"))


def _wider(w: Column, h: Column, bw: Column, bh: Column) -> Column:
    return w.cast("double") / h.cast("double") > bw.cast("double") / bh.cast("double")


def cover_size(w: Column, h: Column, bw: Column, bh: Column) -> tuple[Column, Column]:
    """Width and height after scaling to cover the bucket, rounded half up."""
    scale = F.when(_wider(w, h, bw, bh), bh.cast("double") / h.cast("double")).otherwise(bw.cast("double") / w.cast("double"))
    return F.floor(w * scale + 0.5).cast("long"), F.floor(h * scale + 0.5).cast("long")


def trim_offsets(rw: Column, rh: Column, bw: Column, bh: Column) -> tuple[Column, Column]:
    """Where the centred bucket begins in a resized image."""
    return F.when(rw > bw, F.floor((rw - bw) / 2)).otherwise(0).cast("long"), F.when(rh > bh, F.floor((rh - bh) / 2)).otherwise(0).cast("long")


def fit_rectangle(w: Column, h: Column, bw: Column, bh: Column) -> Column:
    """Left, top, right, bottom of the image fitted into the bucket.

    This is the stored rectangle; it isn't the one that covering and trimming keeps.
    """
    ratio, wide = w.cast("double") / h.cast("double"), _wider(w, h, bw, bh)
    rw = F.when(wide, bw.cast("double")).otherwise(bh * ratio)
    rh = F.when(wide, bw / ratio).otherwise(bh.cast("double"))
    iw, ih = F.floor(rw).cast("long"), F.floor(rh).cast("long")
    left, top = F.floor((bw - iw) / 2).cast("long"), F.floor((bh - ih) / 2).cast("long")
    return F.array(left, top, left + iw, top + ih)


def time_ids(original: Column, crop: Column, bucket: Column) -> Column:
    """Height and width of the original, top and left of the crop, height and width of the bucket, from (w, h) arrays."""
    return F.array(original[1], original[0], crop[1], crop[0], bucket[1], bucket[0])
