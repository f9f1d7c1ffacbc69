"""Row numbers in order, without gathering a group in one task.

Rows are ordered inside bins; counts of the bins, summed on the map side, give
each bin its first number. Even one group that holds most rows is thus spread over BINS tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bins of a group.
BINS = 4096


def _meet(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``other`` for the same keys, of which null equals null."""
    renamed = other.select(*[F.col(c).alias(f"__of_{c}") if c in keys else F.col(c) for c in other.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return rows.join(renamed, same).drop(*[f"__of_{k}" for k in keys])


def _offset(binned: DataFrame, groups: list[str], order: list[str], into: str) -> DataFrame:
    keys = [*groups, "__bin"]
    before = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    counts = binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before.orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return binned.withColumn("__in", inside).transform(_meet, offsets, keys).withColumn(into, (F.col("__in") + F.col("__before")).cast("long")).drop("__bin", "__in", "__before")


def numbered(df: DataFrame, groups: list[str], digest: str, tie: str, into: str) -> DataFrame:
    """``df`` with ``into``: 1, 2, ... within ``groups`` by ``digest`` (hex), then ``tie``; bins are the digest's first three digits."""
    return _offset(df.withColumn("__bin", F.substring(digest, 1, 3)), groups, [digest, tie], into)


def _as_number(column: str, kind: str) -> Column:
    """A number that grows with the column; a time without a zone is taken by its fields, whatever the session's zone."""
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "timestamp_ntz":
        return F.unix_date(F.to_date(column)) * 86400.0 + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)
    return F.col(column).cast("double")


def numbered_in_order(df: DataFrame, groups: list[str], order: list[str], into: str) -> DataFrame:
    """``df`` with ``into``: 1, 2, ... within ``groups`` by ``order``, whose first column is a number or a time.

    Bins cut the first column's range in a group into equal parts; null ones come first.
    """
    valued = df.withColumn("__value", _as_number(order[0], dict(df.dtypes)[order[0]]))
    ranges = valued.groupBy(*groups).agg(F.min("__value").alias("__low"), F.max("__value").alias("__high"))
    part = (F.col("__value") - F.col("__low")) / (F.col("__high") - F.col("__low") + 1)
    binned = _meet(valued, ranges, groups).withColumn("__bin", F.coalesce(F.least(F.floor(part * BINS), F.lit(BINS - 1)), F.lit(-1)).cast("int")).drop("__value", "__low", "__high")
    return _offset(binned, groups, order, into)
