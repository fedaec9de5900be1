"""Turning wide tables into feature vectors, and describing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Pack numeric (or numeric-text) columns into one ``array<double>`` column."""
    return df.withColumn(output, vector(columns))


def vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def unassemble(df: DataFrame, names: Sequence[str], features: str = "features") -> DataFrame:
    """The inverse of ``assemble``: one column per vector element."""
    kept = [c for c in df.columns if c != features]
    return df.select(*kept, *[F.element_at(features, i + 1).alias(c) for i, c in enumerate(names)])


def label_last(df: DataFrame, label: str) -> DataFrame:
    """Move the label column behind the features."""
    return df.select(*[c for c in df.columns if c != label], label)


def encode_label(df: DataFrame, column: str, positive, output: str = "label") -> DataFrame:
    """1 where the class name equals ``positive``, 0 elsewhere."""
    return df.withColumn(output, F.when(F.col(column) == F.lit(positive), 1).otherwise(0))


def missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of null or NaN entries of each column."""
    return df.agg(*[F.count(F.when(_is_missing(c), 1)).alias(c) for c in columns])


def _is_missing(name: str) -> Column:
    value = F.col(name).cast("double")
    return value.isNull() | F.isnan(value)


def standard_scale(
    df: DataFrame, columns: Sequence[str], center: bool = False, on_missing: str = "error"
) -> DataFrame:
    """Divide each column by its sample standard deviation (constant columns become 0).

    Statistics and the missing-value check share one pass; the second pass is a
    projection with literal factors, so nothing is shuffled or joined.
    """
    df = _without_missing(df, columns, on_missing)
    stats = df.agg(
        *[F.stddev_samp(F.col(c).cast("double")).alias(f"std_{i}") for i, c in enumerate(columns)],
        *[F.avg(F.col(c).cast("double")).alias(f"avg_{i}") for i, c in enumerate(columns)],
        *[F.count(F.when(_is_missing(c), 1)).alias(f"bad_{i}") for i, c in enumerate(columns)],
    ).first()
    _raise_on_missing(stats, columns)
    for i, c in enumerate(columns):
        std = stats[f"std_{i}"]
        value = F.col(c).cast("double") - F.lit(stats[f"avg_{i}"] if center else 0.0)
        df = df.withColumn(c, value / F.lit(std) if std else F.lit(0.0))
    return df


def range_scale(df: DataFrame, columns: Sequence[str], on_missing: str = "error") -> DataFrame:
    """Map each column to [0, 1] by its minimum and maximum (constant columns become 0)."""
    df = _without_missing(df, columns, on_missing)
    stats = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{i}") for i, c in enumerate(columns)],
        *[F.count(F.when(_is_missing(c), 1)).alias(f"bad_{i}") for i, c in enumerate(columns)],
    ).first()
    _raise_on_missing(stats, columns)
    for i, c in enumerate(columns):
        lo, hi = stats[f"lo_{i}"], stats[f"hi_{i}"]
        value = F.col(c).cast("double")
        df = df.withColumn(c, (value - F.lit(lo)) / F.lit(hi - lo) if lo is not None and hi > lo else F.lit(0.0))
    return df


def _without_missing(df: DataFrame, columns: Sequence[str], on_missing: str) -> DataFrame:
    if on_missing not in ("error", "drop"):
        raise ValueError("on_missing must be 'error' or 'drop'")
    if on_missing == "drop":
        for c in columns:
            df = df.where(~_is_missing(c))
    return df


def _raise_on_missing(stats, columns: Sequence[str]) -> None:
    bad = {c: stats[f"bad_{i}"] for i, c in enumerate(columns) if stats[f"bad_{i}"]}
    if bad:
        raise ValueError(f"missing values: {bad}; pass on_missing='drop' to leave those rows out")


def scale_vectors(df: DataFrame, features: str = "features", center: bool = False) -> DataFrame:
    """``standard_scale`` for a vector column of any width, through Spark ML."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    packed = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withStd=True, withMean=center)
    scaled = scaler.fit(packed.select("_v")).transform(packed)
    return scaled.withColumn(features, vector_to_array("_s")).select(*df.columns)


def complete(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows whose vector is present and holds only finite numbers."""
    sound = F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(F.coalesce(sound, F.lit(False)))


def attribute_lists(df: DataFrame, keys: Sequence[str], features: str = "features") -> DataFrame:
    """Melt vectors to one row per (row, feature): keys, feature, value."""
    return df.select(*keys, F.posexplode(features).alias("feature", "value"))


def pivot_lists(df: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The inverse of ``attribute_lists``: one vector per key."""
    wide = df.groupBy(*keys).pivot("feature", list(range(width))).agg(F.first("value"))
    return wide.select(*keys, F.array(*[F.col(f"`{i}`") for i in range(width)]).alias("features"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per attribute: n, min, max, mean, sample std and coefficient of variation in percent.

    One aggregation over the wide rows, then the single result row is unpivoted.
    """
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [
            F.count(v).alias(f"n_{i}"),
            F.min(v).alias(f"min_{i}"),
            F.max(v).alias(f"max_{i}"),
            F.avg(v).alias(f"avg_{i}"),
            F.stddev_samp(v).alias(f"std_{i}"),
        ]
    entries = [
        F.struct(
            F.lit(c).alias("attribute"),
            F.col(f"n_{i}").alias("n"),
            F.col(f"min_{i}").alias("min_value"),
            F.col(f"max_{i}").alias("max_value"),
            F.col(f"avg_{i}").alias("mean_value"),
            F.col(f"std_{i}").alias("std_value"),
            F.when(F.col(f"avg_{i}") != 0, 100.0 * F.col(f"std_{i}") / F.col(f"avg_{i}")).alias("cv_percent"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share in percent of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(label, "n", (100.0 * F.col("n") / total).alias("percent"))


def cell_position(df: DataFrame, neuron: str, cols: int) -> DataFrame:
    """Add the grid row and column of a neuron number."""
    return df.withColumn("row", F.expr(f"cast({neuron} div {cols} as int)")).withColumn(
        "col", (F.col(neuron) % cols).cast("int")
    )
