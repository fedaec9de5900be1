"""Saving and loading the small models as tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from graticule.plans.som import Codebook
from graticule.plans.tree import TreeModel


def save_codebook(spark: SparkSession, codebook: Codebook, path: str) -> None:
    codebook.to_table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_codebook(spark: SparkSession, path: str, rows: int, cols: int) -> Codebook:
    return Codebook.from_table(spark.read.parquet(path), rows, cols)


def save_trees(spark: SparkSession, model: TreeModel, path: str) -> None:
    model.to_table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_trees(spark: SparkSession, path: str) -> TreeModel:
    return TreeModel.from_table(spark.read.parquet(path))
