"""Buckets of equal resolution: their sizes, where each begins in a flat index, and lookups by index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def inventory(items: DataFrame, bucket: str = "bucket", batch_size: int = 8) -> DataFrame:
    """One row per bucket: w, h, n, first and past-the-last flat index, and how many batches it gives.

    The window runs over one row per bucket.
    """
    counts = items.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.orderBy("w", "h").rowsBetween(W.unboundedPreceding, 0))
    flat = counts.select(F.col(bucket)["w"].alias("w"), F.col(bucket)["h"].alias("h"), "n").withColumn("end_index", upto)
    return flat.select("w", "h", "n", (F.col("end_index") - F.col("n")).alias("start_index"), "end_index", F.ceil(F.col("n") / batch_size).cast("long").alias("n_batches"))


#: Buckets up to this number are searched in an array; more of them meet indexes by equal cells.
SEARCHED = 4096


def locate(indexes: DataFrame, sizes: DataFrame, index: str = "idx") -> DataFrame:
    """The bucket of every flat index, and the place in it; an index that no bucket has is left out.

    The first indexes of the buckets, few and counted, are one sorted array in which each index is looked up by binary
    search, without a join. More than ``SEARCHED`` buckets are listed in the cells of a grid that they touch and joined by cell.
    """
    bounds = sizes.select("w", "h", "start_index", "end_index").where("n > 0").orderBy("start_index").limit(SEARCHED + 1).collect()
    if len(bounds) > SEARCHED:
        return _by_cells(indexes, sizes, index)
    if not bounds:
        return indexes.select(index, *[F.lit(None).cast("long").alias(c) for c in ("w", "h", "place")]).limit(0)
    wh = dict(sizes.dtypes)
    known = F.array(*[F.struct(F.lit(b.start_index).cast("long").alias("a"), F.lit(b.end_index).cast("long").alias("z"), F.lit(b.w).cast(wh["w"]).alias("w"), F.lit(b.h).cast(wh["h"]).alias("h")) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    # The last bucket that doesn't begin behind the index: steps of halving size, taken where they don't go too far.
    last = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step)["a"] <= F.col(index), at + step).otherwise(at))
    found = indexes.withColumn("__of", F.get(known, last)).where((F.col("__of.a") <= F.col(index)) & (F.col(index) < F.col("__of.z")))
    return found.select(index, F.col("__of.w").alias("w"), F.col("__of.h").alias("h"), (F.col(index) - F.col("__of.a")).alias("place"))


def _by_cells(indexes: DataFrame, sizes: DataFrame, index: str) -> DataFrame:
    """As ``locate``, by an equal join on cells as wide as buckets are on average."""
    n, end = sizes.where("n > 0").agg(F.count(F.lit(1)), F.max("end_index")).first()
    width = max(1, end // n)
    cells = F.sequence(F.floor(F.col("start_index") / width), F.floor((F.col("end_index") - 1) / width))
    listed = sizes.where("n > 0").select("w", "h", "start_index", "end_index", F.explode(cells).alias("__cell"))
    met = indexes.withColumn("__cell", F.floor(F.col(index) / width)).join(listed, "__cell").where((F.col(index) >= F.col("start_index")) & (F.col(index) < F.col("end_index")))
    return met.select(index, "w", "h", (F.col(index) - F.col("start_index")).alias("place"))
