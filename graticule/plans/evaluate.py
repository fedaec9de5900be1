"""Accuracy, repeated hold-out, cross-validation and ROC points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.functions.dense import FlatTrees, matrix
from graticule.functions.hashing import group_of
from graticule.operators.sampling import GROUPS_SALT, other_folds, training_folds
from graticule.operators.scans import running_sums
from graticule.plans.tree import TreeModel, predict, train_trees


def accuracy(rows: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows, hits and share of right predictions, overall or per group."""
    hit = F.when(F.col(label).cast("double") == F.col(prediction).cast("double"), 1).otherwise(0)
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"))
    return counted.withColumn("accuracy", F.col("hits") / F.col("n"))


def cross_validate(
    rows: DataFrame, key: Sequence, folds: int = 10, seed: int = 0, fold: str | None = None, **options
) -> tuple[DataFrame, TreeModel]:
    """Accuracy per fold; all folds' trees grow together.

    Each row trains the ``folds - 1`` trees of the other folds, read once for all of them, and is
    tested by its own. Pass ``fold`` to use an existing fold column.
    """
    marked = rows.withColumn("fold", F.col(fold)) if fold else training_folds(rows, key, folds, seed)
    model = train_trees(marked.withColumn("tree_ids", other_folds(folds)), **options)
    tested = predict(marked.withColumn("tree_id", F.col("fold")), model)
    return accuracy(tested, ["fold"]), model


def repeated_holdout(
    rows: DataFrame,
    key: Sequence,
    seeds: Sequence[int],
    depths: Sequence[int],
    trees: int = 12,
    train_percent: int = 90,
    **options,
) -> DataFrame:
    """Forest accuracy for every (seed, depth): (seed, depth, n, hits, accuracy).

    Every seed draws its own split and its own groups. All forests grow in one
    training call to the largest depth; a smaller depth is the same forest cut off.
    """
    training, testing = [], []
    for i, seed in enumerate(seeds):
        is_train = group_of(*key, groups=100, seed=seed) < train_percent
        training.append(F.when(is_train, F.lit(i * trees) + group_of(*key, groups=trees, seed=seed + GROUPS_SALT)))
        testing.append(F.when(~is_train, F.lit(i)))
    marked = rows.select("features", "label", F.array_compact(F.array(*training)).alias("tree_ids"), F.array_compact(F.array(*testing)).alias("runs"))
    model = train_trees(marked, max_depth=max(depths), **options)
    tested = marked.select("features", "label", F.explode("runs").alias("run")).select(
        "run", "label", F.explode_outer(_votes_by_depth(model, trees, sorted(depths))).alias("v")
    )
    scored = tested.select("run", "label", "v.depth", F.when(2 * F.col("v.votes") > F.col("v.trees"), 1).otherwise(0).alias("prediction"))
    seed_of = F.element_at(F.array(*[F.lit(s) for s in seeds]), F.col("run") + 1)
    return accuracy(scored, ["run", "depth"]).select(seed_of.alias("seed"), "depth", "n", "hits", "accuracy")


def _votes_by_depth(model: TreeModel, trees: int, depths: Sequence[int]) -> Column:
    """For a row of a run: array of (depth, votes, trees), all depths in one walk down the run's trees."""
    flat = FlatTrees(model.nodes)
    labels = np.array([r.label for r in model.nodes])
    levels = list(depths)

    @F.arrow_udf("array<struct<depth: int, votes: int, trees: int>>")
    def count(runs: pa.Array, vectors: pa.Array) -> pa.Array:
        run = runs.to_numpy(zero_copy_only=False)
        x = matrix(vectors, len(vectors[0].as_py()) if len(vectors) else 0)
        votes = np.zeros((len(x), len(levels)), np.int32)
        grown = np.zeros(len(x), np.int32)
        for tree_id, root in zip(flat.tree_ids, flat.roots):
            own = np.flatnonzero(run == tree_id // trees)
            if not len(own):
                continue
            grown[own] += 1
            current, taken = np.full(len(own), root), 0
            for j, depth in enumerate(levels):
                current, taken = flat.descend(x[own], current, depth - 1 - taken), depth - 1
                votes[own, j] += labels[current] > 0.5
        entries = pa.StructArray.from_arrays(
            [
                pa.array(np.tile(np.array(levels, np.int32), len(x))),
                pa.array(votes.ravel()),
                pa.array(np.repeat(grown, len(levels))),
            ],
            ["depth", "votes", "trees"],
        )
        offsets = np.arange(len(x) + 1, dtype=np.int32) * len(levels)
        return pa.ListArray.from_arrays(pa.array(offsets), entries)

    return count(F.col("run"), F.col("features").cast("array<double>"))


def roc_points(
    rows: DataFrame,
    score: str,
    label: str = "label",
    rates: Sequence[float] = (0.01, 0.02, 0.05, 0.1, 0.2),
    ranges: int | None = None,
) -> DataFrame:
    """Largest true-positive rate reachable within each false-positive rate.

    Counts per distinct score come first, so equal scores are one point; the
    cumulative sums run over score ranges and survive any number of scores.
    """
    counts = rows.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )
    falling = counts.withColumn("falling", -F.col("score"))
    sums = running_sums(
        falling,
        {"tp": "pos", "fp": "neg"},
        ["falling"],
        totals={"positives": "pos", "negatives": "neg"},
        ranges=ranges,
    )
    points = sums.select((F.col("tp") / F.col("positives")).alias("tpr"), (F.col("fp") / F.col("negatives")).alias("fpr"))
    best = points.agg(
        *[F.coalesce(F.max(F.when(F.col("fpr") <= r, F.col("tpr"))), F.lit(0.0)).alias(f"at_{i}") for i, r in enumerate(rates)]
    )
    entries = [
        F.struct(F.lit(float(r)).alias("max_fpr"), F.col(f"at_{i}").alias("tpr")) for i, r in enumerate(rates)
    ]
    return best.select(F.inline(F.array(*entries)))
