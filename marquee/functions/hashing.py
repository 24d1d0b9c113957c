"""Repeatable pseudo-random numbers that any SQL engine with MD5 can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import Col, _col

HASH_RANGE = 1 << 32


def hash32(*keys: Col) -> Column:
    """Whole number in [0, 2^32) drawn from the MD5 of the keys joined by ':'."""
    joined = F.concat_ws(":", *[_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def uniform(*keys: Col) -> Column:
    """Double strictly inside (0, 1)."""
    return (hash32(*keys) + F.lit(0.5)) / F.lit(float(HASH_RANGE))


def draw_below(limit: Col, *keys: Col) -> Column:
    """Whole number in [0, limit)."""
    return F.pmod(hash32(*keys), _col(limit).cast("bigint"))
