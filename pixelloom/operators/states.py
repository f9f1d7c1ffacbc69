"""State tables: one row per named tensor, joined and put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = ("q", "k", "v")


def fuse_attention(parts: DataFrame) -> DataFrame:
    """``layer`` and ``values`` (query, key and value one behind the other) of (layer, part, values); a layer that lacks a part is an error."""
    held = parts.groupBy("layer").agg(*[F.max(F.when(F.col("part") == p, F.col("values"))).alias(p) for p in PARTS])
    lacking = reduce(lambda a, b: a | b, [F.col(p).isNull() for p in PARTS])
    broken = F.raise_error(F.concat(F.lit("a part of the attention weights is missing: "), F.col("layer"))).cast(parts.schema["values"].dataType)
    return held.select("layer", F.when(lacking, broken).otherwise(F.concat(*PARTS)).alias("values"))


def merge_components(components: dict[str, DataFrame], transposed: dict[str, str] | None = None) -> DataFrame:
    """One table (name, shape) of all components' names behind their prefixes; of equal names the last component's stays.

    ``transposed`` has full names that get another name and a shape the other way round.
    """
    prefixed = [df.select(F.concat(F.lit(prefix), F.col("name")).alias("name"), "shape", F.lit(k).alias("__k")) for k, (prefix, df) in enumerate(components.items())]
    every = reduce(DataFrame.unionByName, prefixed).groupBy("name").agg(F.max_by("shape", "__k").alias("shape"))
    name, shape = F.col("name"), F.col("shape")
    for old, new in (transposed or {}).items():
        turned = F.col("name") == old
        name, shape = F.when(turned, F.lit(new)).otherwise(name), F.when(turned, F.reverse("shape")).otherwise(shape)
    return every.select(name.alias("name"), shape.alias("shape"))
