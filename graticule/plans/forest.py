"""Voting forests: one tree per disjoint random group of rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.functions.dense import FlatTrees, matrix
from graticule.operators.sampling import assign_groups
from graticule.plans.tree import TreeModel, train_trees, tree_expression

# Forests up to this many nodes also fit one generated expression.
EXPRESSION_NODES = 100


def train_forest(rows: DataFrame, key: Sequence, trees: int = 12, seed: int = 0, **options) -> TreeModel:
    """All trees grow in the same passes; an empty group gives no tree."""
    return train_trees(assign_groups(rows, key, trees, seed), **options)


def votes(model: TreeModel, features: Column | str = "features") -> Column:
    """How many trees vote 1: a narrow Arrow projection, no shuffle."""
    trees = FlatTrees(model.nodes)
    labels = np.array([r.label for r in model.nodes])

    @F.arrow_udf("int")
    def count(vectors: pa.Array) -> pa.Array:
        width = len(vectors[0].as_py()) if len(vectors) else 0
        x = matrix(vectors, width)
        total = np.zeros(len(x), np.int32)
        for root in trees.roots:
            total += labels[trees.descend(x, np.full(len(x), root))] > 0.5
        return pa.array(total, pa.int32())

    vector = F.col(features) if isinstance(features, str) else features
    return count(vector.cast("array<double>"))


def votes_expression(model: TreeModel, features: Column | str = "features", max_nodes: int = EXPRESSION_NODES) -> Column:
    """The same count without a Python worker; forests of more than ``max_nodes`` nodes are counted by ``votes``."""
    if len(model.nodes) > max_nodes:
        return votes(model, features)
    total = F.lit(0)
    for tree_id in model.tree_ids:
        total = total + tree_expression(model, tree_id, features).cast("int")
    return total


def predict_forest(rows: DataFrame, model: TreeModel, features: str = "features") -> DataFrame:
    """Add ``votes``, ``score`` (vote share) and ``prediction`` (1 only for a strict majority)."""
    trees = len(model.tree_ids)
    return (
        rows.withColumn("votes", votes(model, features))
        .withColumn("score", F.col("votes") / F.lit(float(trees)))
        .withColumn("prediction", F.when(2 * F.col("votes") > trees, 1).otherwise(0))
    )
