"""Randomness as a function of a row key.

A draw depends only on (key, seed), never on partitioning, row order or which
executor recomputes the row, so a lost task redraws the same values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hashed(*key, seed: int | Column = 0) -> Column:
    last = seed if isinstance(seed, Column) else F.lit(seed).cast("bigint")
    return F.xxhash64(*[_column(c) for c in key], last)


def unit_interval(*key, seed: int | Column = 0) -> Column:
    """Uniform double in [0, 1) built from the top 53 bits of the hash."""
    return F.shiftrightunsigned(hashed(*key, seed=seed), 11) * F.lit(2.0**-53)


def group_of(*key, groups: int, seed: int = 0) -> Column:
    """Group number in 0..groups-1, near-equal sizes for distinct keys."""
    return F.pmod(hashed(*key, seed=seed), F.lit(groups).cast("bigint")).cast("int")
