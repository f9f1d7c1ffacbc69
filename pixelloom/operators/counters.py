"""Counts of what a job does, taken while it writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(rows: DataFrame, **kinds: Column) -> tuple[DataFrame, Observation]:
    """``rows``, and an observation that has, once they have been written, how many there were (``rows``) and for how many each of ``kinds`` holds.

    The metrics ride on the write; nothing is read a second time.
    """
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(kind.cast("long")), F.lit(0)).alias(name) for name, kind in kinds.items()]]
    return rows.observe(seen, *counts), seen
