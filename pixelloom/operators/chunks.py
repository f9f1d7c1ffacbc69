"""Work dealt out in chunks of bounded rows and bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered_in_order

ROWS = 1000


def chunked(items: DataFrame, order: list[str], rows: int = ROWS, size: str | None = None, limit: int = 1 << 28) -> DataFrame:
    """``items`` with ``chunk`` (from 0): ``rows`` at a time in ``order``, whose first column is a number or a time; only the last chunk has fewer.

    Row numbers come from counts of bins, without a sort of all rows in one task. With ``size``, a column of
    bytes, chunks are cut further into parts (``part``, from 0 in each chunk): a part takes rows until
    the next one would carry it over ``limit``, so that only rows larger than the limit exceed it, each a part of
    its own. Parts are found within a chunk's ``rows`` sizes.
    """
    numbered = numbered_in_order(items, [], order, "__at").withColumn("chunk", F.floor((F.col("__at") - 1) / rows).cast("long"))
    if size is None:
        return numbered.drop("__at")
    sizes = numbered.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("__at", F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")))).alias("s"))

    def put(done, x):
        over = (done["held"] > 0) & (done["held"] + x["n"] > limit)
        part = F.when(over, done["part"] + 1).otherwise(done["part"])
        return F.struct(part.alias("part"), F.when(over, x["n"]).otherwise(done["held"] + x["n"]).alias("held"), F.concat(done["parts"], F.array(part)).alias("parts"))

    start = F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("parts"))
    parts = sizes.select(F.explode(F.arrays_zip(F.col("s.__at").alias("at"), F.aggregate("s", start, put)["parts"].alias("part"))).alias("p")).select(F.col("p.at").alias("__at"), F.col("p.part").alias("part"))
    return numbered.join(parts, "__at").drop("__at")
