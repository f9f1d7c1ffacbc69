"""Draws that depend on keys alone: the same in every engine, in any order, after any restart."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


def digest(*keys) -> Column:
    """MD5 of the keys, joined by colons."""
    return F.md5(F.concat_ws(":", *map(_text, keys)))


def uniform(*keys) -> Column:
    """A draw from [0, 1): 32 bits of the keys' digest."""
    return F.conv(F.substring(digest(*keys), 1, 8), 16, 10).cast("double") / float(1 << 32)


def normal(*keys) -> Column:
    """A standard normal draw, by Box and Muller from two uniform ones."""
    u1, u2 = uniform(*keys, "a"), uniform(*keys, "b")
    return F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(2 * math.pi * u2)
