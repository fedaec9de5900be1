"""Sampling, splitting and grouping rows by a hash of their key."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.functions.hashing import group_of, unit_interval

# Added to the seed, so that groups and folds do not repeat the hash of a split with the same seed.
GROUPS_SALT = 1_000_003
FOLDS_SALT = 2_000_003
# Rates above this are drawn as a sum of independent parts.
POISSON_PART = 16.0


def poisson_copies(key: Sequence, fraction: float, seed: int = 7) -> Column:
    """How often a row is drawn in a sample with replacement of the given rate.

    Inverts the Poisson distribution function at the key's uniform draw; the
    table of cut points ends where the remaining mass is below 2**-53. A large rate
    is a sum of independent draws of equal smaller rates.
    """
    if not 0 < fraction < math.inf:
        raise ValueError("fraction must be positive")
    parts = math.ceil(fraction / POISSON_PART)
    if parts > 1:
        seeds = F.array(*[F.lit(seed + 3_000_017 * i).cast("bigint") for i in range(parts)]) if parts <= 8 else F.transform(
            F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: i.cast("bigint") * 3_000_017 + seed
        )
        cuts = F.array(*[F.lit(c) for c in _poisson_cuts(fraction / parts)])
        drawn = lambda s: F.size(F.filter(cuts, lambda c: unit_interval(*key, seed=s) >= c))
        return F.aggregate(seeds, F.lit(0), lambda a, s: a + drawn(s))
    u = unit_interval(*key, seed=seed)
    copies = F.lit(0)
    for cut in _poisson_cuts(fraction):
        copies = copies + F.when(u >= F.lit(cut), 1).otherwise(0)
    return copies


def _poisson_cuts(fraction: float) -> list[float]:
    cuts, mass, total, k = [], math.exp(-fraction), 0.0, 0
    while total + mass < 1.0 - 2.0**-53:
        total += mass
        cuts.append(total)
        k += 1
        mass *= fraction / k
        if mass < 2.0**-60 and k > fraction:
            break
    return cuts


@dataclass(frozen=True)
class PoissonDraw:
    """``poisson_copies`` counted inside a task: Spark hands over the uniform draws, samples of one key and seed share them."""

    key: tuple
    fraction: float
    seed: int = 7

    def __post_init__(self) -> None:
        if not 0 < self.fraction < math.inf:
            raise ValueError("fraction must be positive")

    @property
    def parts(self) -> int:
        return math.ceil(self.fraction / POISSON_PART)

    def draws(self) -> dict[tuple, Column]:
        """The uniform draws, by what tells them apart."""
        seeds = [self.seed + 3_000_017 * i for i in range(self.parts)]
        return {(self.key, s): unit_interval(*self.key, seed=s) for s in seeds}

    def copies(self, drawn: Sequence[np.ndarray]) -> np.ndarray:
        cuts = np.array(_poisson_cuts(self.fraction / self.parts))
        return np.sum([np.searchsorted(cuts, u, side="right") for u in drawn], axis=0)


def sample_with_replacement(df: DataFrame, key: Sequence, fraction: float, seed: int = 7) -> DataFrame:
    """Poisson sample: each row appears ``poisson_copies`` times."""
    copied = df.withColumn("_copies", poisson_copies(key, fraction, seed)).where("_copies > 0")
    return copied.withColumn("_copy", F.explode_outer(F.expr("sequence(1, _copies)"))).drop("_copies", "_copy")


def holdout(df: DataFrame, key: Sequence, train_percent: int = 90, seed: int = 0) -> DataFrame:
    """Add ``is_train``: true for about ``train_percent`` of the keys."""
    return df.withColumn("is_train", group_of(*key, groups=100, seed=seed) < train_percent)


def split(df: DataFrame, key: Sequence, train_percent: int = 90, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    marked = holdout(df, key, train_percent, seed)
    return marked.where("is_train").drop("is_train"), marked.where("not is_train").drop("is_train")


def assign_groups(df: DataFrame, key: Sequence, groups: int, seed: int = 0, output: str = "tree_id") -> DataFrame:
    """Disjoint random groups, one per tree; no shuffle, only a column."""
    return df.withColumn(output, group_of(*key, groups=groups, seed=seed + GROUPS_SALT))


def training_folds(df: DataFrame, key: Sequence, folds: int = 10, seed: int = 0) -> DataFrame:
    """Add the test ``fold`` of each row."""
    return df.withColumn("fold", group_of(*key, groups=folds, seed=seed + FOLDS_SALT))


def other_folds(folds: int) -> Column:
    """The ``folds - 1`` models that a row with a ``fold`` trains, as an array."""
    return F.array_except(F.array(*[F.lit(i) for i in range(folds)]), F.array(F.col("fold").cast("int")))
