"""Sums and arg-min reductions. Each is a partial plus a final hash aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sum(value).alias("total"))


def total_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("total"))


def _smallest(value: str, position: Sequence[str]) -> Column:
    return F.min(F.struct(F.col(value), *[F.col(p) for p in position]))


def argmin(df: DataFrame, value: str, position: Sequence[str]) -> DataFrame:
    """The smallest value and its position, ties to the lowest position."""
    return df.agg(_smallest(value, position).alias("best")).select("best.*")


def argmin_by(df: DataFrame, keys: Sequence[str], value: str, position: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(_smallest(value, position).alias("best")).select(*keys, "best.*")


def argmin_of_array(values: Column) -> Column:
    """Zero-based index of the smallest element of an array column."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def weighted_means(df: DataFrame, keys: Sequence[str], value: Column, weight: Column, old: Column) -> DataFrame:
    """Weighted mean per key, or the old value where no weight arrived."""
    sums = df.groupBy(*keys).agg(
        F.sum(value * weight).alias("_num"), F.sum(weight).alias("_den"), F.max(old).alias("_old")
    )
    return sums.select(
        *keys, F.when(F.col("_den") != 0, F.col("_num") / F.col("_den")).otherwise(F.col("_old")).alias("mean_value")
    )
