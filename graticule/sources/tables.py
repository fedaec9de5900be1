"""Reading delimited numeric tables and making generated ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.functions.hashing import unit_interval
from graticule.operators.scans import positions


def numeric_schema(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` double" for n in names)


def read_csv(spark: SparkSession, path: str, names: Sequence[str], sep: str = ",", strict: bool = True) -> DataFrame:
    """Headerless delimited file as double columns; a malformed line fails the job when ``strict``."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return spark.read.schema(numeric_schema(names)).option("mode", mode).csv(path, sep=sep, header=False)


def read_whitespace(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Columns separated by any run of blanks or tabs; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = F.split(F.trim("value"), r"\s+")
    return lines.select(*[fields[i].cast("double").alias(n) for i, n in enumerate(names)])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=False)


def label_by_position(
    df: DataFrame, order_by: Sequence[str], first: int, output: str = "label", ranges: int | None = None
) -> DataFrame:
    """1 for the first ``first`` rows in the given order, 0 for the rest."""
    placed = positions(df, order_by, output="_pos", ranges=ranges)
    return placed.withColumn(output, F.when(F.col("_pos") < first, 1).otherwise(0)).drop("_pos")


def from_rows(spark: SparkSession, vectors: Sequence[Sequence[float]], labels: Sequence[int] | None = None) -> DataFrame:
    """A small in-memory collection as a distributed table."""
    if labels is None:
        return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "id bigint, features array<double>")
    data = [(i, list(map(float, v)), int(y)) for i, (v, y) in enumerate(zip(vectors, labels, strict=True))]
    return spark.createDataFrame(data, "id bigint, features array<double>, label int")


def uniform_vectors(df: DataFrame, key: str, width: int, seed: int = 0) -> DataFrame:
    """One uniform [0, 1) vector per key, the same on every run and partitioning."""
    draws = [unit_interval(F.col(key), F.lit(i).cast("bigint"), seed=seed) for i in range(width)]
    return df.select(key, F.array(*draws).alias("features"))


def uniform_table(spark: SparkSession, rows: int, width: int, seed: int = 0, partitions: int = 10) -> DataFrame:
    return uniform_vectors(spark.range(0, rows, 1, partitions), "id", width, seed)
