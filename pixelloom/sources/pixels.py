"""Pictures as pixels: decoded by Spark's image source, resampled by area and trimmed to their bucket.

Spark decodes in the JVM and gives each picture's bytes, blue first. Buckets, sizes
and offsets are expressions; only the averaging runs in Python, on Arrow batches.

Area resampling: an output pixel is the mean of the input over the box that it
covers, parts of pixels by their share. Running sums along one axis give a box's sum as the
difference of two of them, between which they are straight lines; so each axis takes one
cumulative sum and one interpolation, whatever the factor. Enlarging takes the same
means: a box inside a pixel has that pixel's value.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import cover_size, nearest_bucket, trim_offsets

FITTED = "path string, width int, height int, bucket_w int, bucket_h int, pixels binary"


def pictures(spark: SparkSession, root: str) -> DataFrame:
    """path, width, height, channels and data of the pictures below ``root``; files that aren't pictures are left out.

    JPEG, PNG, GIF and BMP, as the JVM reads them; names that begin with ``_`` are left out by Spark.
    """
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
    return found.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Height x width x 3, red first; grey is repeated and transparency dropped."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def _along(pixels: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Means over ``size`` equal boxes along an axis."""
    n = pixels.shape[axis]
    sums = np.concatenate([np.zeros_like(pixels.take([0], axis), np.float64), np.cumsum(pixels, axis=axis, dtype=np.float64)], axis=axis)
    at = np.arange(size + 1) * n / size
    low = np.minimum(at.astype(np.int64), n - 1)
    part = (at - low).reshape([-1 if k == axis else 1 for k in range(pixels.ndim)])
    upto = sums.take(low, axis) * (1 - part) + sums.take(low + 1, axis) * part
    return np.diff(upto, axis=axis) * (size / n)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area means as whole numbers, halves rounded up."""
    return np.clip(np.floor(_along(_along(pixels, height, 0), width, 1) + 0.5 + 1e-9), 0, 255).astype(np.uint8)


def shaped(images: DataFrame, size: tuple[Column, Column], box: tuple[Column, Column], offsets: tuple[Column, Column]) -> DataFrame:
    """Pictures resampled to ``size`` and cut to the ``box`` (width, height) from ``offsets`` on: ``FITTED``, pixels red first, row by row."""
    sized = images.select(
        "path", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("channels").cast("int").alias("channels"),
        *[c.cast("int").alias(n) for n, c in zip(("w", "h", "bucket_w", "bucket_h", "x", "y"), (*size, *box, *offsets), strict=True)], "data",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                new = resized(rgb(r["data"], r["height"], r["width"], r["channels"]), r["w"], r["h"])
                out.append(new[r["y"] : r["y"] + r["bucket_h"], r["x"] : r["x"] + r["bucket_w"]].tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("path", "width", "height", "bucket_w", "bucket_h")], pa.array(out, pa.binary())], [c.split()[0] for c in FITTED.split(", ")])

    return sized.mapInArrow(run, FITTED)


def fitted(images: DataFrame) -> DataFrame:
    """Pictures resampled to cover their nearest bucket and trimmed to it in the middle."""
    w, h = F.col("width"), F.col("height")
    known = images.withColumn("bucket", nearest_bucket(w, h))
    bucket = F.col("bucket.w"), F.col("bucket.h")
    size = cover_size(w, h, *bucket)
    return shaped(known, size, bucket, trim_offsets(*size, *bucket))


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of height x width x 3 bytes."""
    rows = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
