"""Map quality, clustering, classification and map views."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.functions.dense import matrix, nearest, squared_distance, term_by_term
from graticule.operators.sampling import PoissonDraw
from graticule.plans.som import Codebook, assign, samples_of_maps
from graticule.session import small_side


def _steps(codebook: Codebook):
    """Absolute row and column distance between the first and second unit."""
    c = codebook.cols
    dr = F.abs(F.expr(f"bmu div {c}") - F.expr(f"second div {c}"))
    dc = F.abs(F.col("bmu") % c - F.col("second") % c)
    return dr, dc


def quality(rows: DataFrame, codebook: Codebook, features: str = "features") -> DataFrame:
    """One row: n, quantization_error, diagonal_rate, adjacent_rate, topographic_error.

    ``diagonal_rate`` is the share of rows whose two best units touch corner to
    corner, ``adjacent_rate`` the share whose two best units touch at all, and
    ``topographic_error`` the customary share whose two best units do not touch.
    """
    dr, dc = _steps(codebook)
    diagonal = F.when((dr == 1) & (dc == 1), 1.0).otherwise(0.0)
    adjacent = F.when((dr <= 1) & (dc <= 1) & (dr + dc > 0), 1.0).otherwise(0.0)
    return assign(rows.select(features), codebook, features).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("distance").alias("quantization_error"),
        F.avg(diagonal).alias("diagonal_rate"),
        F.avg(adjacent).alias("adjacent_rate"),
        (1.0 - F.avg(adjacent)).alias("topographic_error"),
    )


def qualities(
    rows: DataFrame, books: Sequence[Codebook], copies: Sequence[Column | PoissonDraw] | None = None, features: str = "features"
) -> DataFrame:
    """``quality`` of several maps, numbered in ``map``, each on the sample it draws, from one reading of ``rows``."""
    drawn_rows, drawn_of = samples_of_maps(rows, books, copies, features)
    names = ["map", "n", "distance", "diagonal", "adjacent"]

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, distance = np.zeros((3, len(books)), np.int64), np.zeros(len(books))
        for batch in batches:
            x, samples = drawn_of(batch)
            for m, (book, (drawn, again)) in enumerate(zip(books, samples)):
                if not len(drawn):
                    continue
                own, k = x[drawn], min(2, book.neurons)
                index = nearest(own, book.weights, k)
                first, second = np.divmod(index[:, 0], book.cols), np.divmod(index[:, k - 1], book.cols)
                dr, dc = np.abs(first[0] - second[0]), np.abs(first[1] - second[1])
                distance[m] += again @ np.sqrt(squared_distance(own, book.weights, index[:, 0]))
                counts[:, m] += [again.sum(), again[(dr == 1) & (dc == 1)].sum(), again[(dr <= 1) & (dc <= 1) & (dr + dc > 0)].sum()]
        columns = [pa.array(np.arange(len(books)), pa.int32()), *map(pa.array, (counts[0], distance, counts[1], counts[2]))]
        yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "map int, n bigint, distance double, diagonal bigint, adjacent bigint"
    # A map that draws no row has a line too.
    none = rows.sparkSession.createDataFrame([(m, 0, 0.0, 0, 0) for m in range(len(books))], kinds)
    found = drawn_rows.mapInArrow(partials, kinds).unionByName(none).groupBy("map").agg(*[F.sum(c).alias(c) for c in names[1:]])
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    return found.select(
        "map", "n", share("distance").alias("quantization_error"), share("diagonal").alias("diagonal_rate"),
        share("adjacent").alias("adjacent_rate"), (1.0 - share("adjacent")).alias("topographic_error"),
    )


def clusters(rows: DataFrame, codebook: Codebook, features: str = "features") -> DataFrame:
    """Every neuron as a cluster: (neuron, row, col, n, mean_distance), empty ones included."""
    sizes = (
        assign(rows.select(features), codebook, features)
        .groupBy("bmu")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"))
    )
    grid = codebook.to_table(rows.sparkSession).select("neuron", "row", "col")
    return grid.join(sizes, grid["neuron"] == sizes["bmu"], "left").select(
        "neuron", "row", "col", F.coalesce("n", F.lit(0)).alias("n"), "mean_distance"
    )


def component_planes(spark: SparkSession, codebook: Codebook) -> DataFrame:
    """(row, col, component, weight) of the trained map."""
    table = codebook.to_table(spark)
    return table.select("row", "col", F.posexplode("weights").alias("component", "weight"))


def weight_mosaic(spark: SparkSession, codebook: Codebook, height: int, width: int) -> DataFrame:
    """Weights as one grey image: each neuron's vector is a height x width tile."""
    if height * width != codebook.width:
        raise ValueError("a tile must hold one pixel per vector element")
    planes = component_planes(spark, codebook)
    return planes.select(
        F.expr(f"cast(row * {height} + component div {width} as int)").alias("y"),
        F.expr(f"cast(col * {width} + component % {width} as int)").alias("x"),
        (255.0 * F.col("weight")).alias("grey"),
    )


def distance_map(spark: SparkSession, codebook: Codebook) -> DataFrame:
    """U-matrix: mean weight distance of each neuron to its (up to four) grid neighbours."""
    rows, cols, w = codebook.rows, codebook.cols, codebook.weights
    out = []
    for i in range(codebook.neurons):
        r, c = divmod(i, cols)
        near = [(r + a, c + b) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]
        near = [x * cols + y for x, y in near if 0 <= x < rows and 0 <= y < cols]
        mean = float(np.mean([np.linalg.norm(w[i] - w[j]) for j in near])) if near else 0.0
        out.append((i, r, c, mean))
    return spark.createDataFrame(out, "neuron int, row int, col int, mean_distance double")


def density_map(rows: DataFrame, codebook: Codebook, radius: float, features: str = "features") -> DataFrame:
    """P-matrix: rows within ``radius`` of each neuron's weights; one count per neuron and task is shuffled."""
    w, width = codebook.weights, codebook.width

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(w), np.int64)
        step = max(1, 250_000 // len(w))
        for batch in batches:
            x = matrix(batch.column(0), width)
            for lo in range(0, len(x), step):
                n += (np.sqrt(term_by_term(x[lo : lo + step], w)) <= radius).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w)), pa.int32()), pa.array(n)], ["neuron", "n"])

    found = rows.select(features).mapInArrow(counts, "neuron int, n bigint").groupBy("neuron").agg(F.sum("n").alias("n"))
    grid = codebook.to_table(rows.sparkSession).select("neuron", "row", "col")
    return grid.join(found, "neuron", "left").select("neuron", "row", "col", F.coalesce("n", F.lit(0)).alias("n"))


def label_units(rows: DataFrame, codebook: Codebook, label: str = "label", features: str = "features") -> DataFrame:
    """(bmu, unit_label): the most frequent label of each neuron, ties to the lowest label."""
    counts = assign(rows.select(features, label), codebook, features).groupBy("bmu", label).agg(
        F.count(F.lit(1)).alias("n")
    )
    best = F.min(F.struct((-F.col("n")).alias("order"), F.col(label).alias("unit_label")))
    return counts.groupBy("bmu").agg(best.alias("b")).select("bmu", F.col("b.unit_label").alias("unit_label"))


def classify(rows: DataFrame, codebook: Codebook, labels: DataFrame, features: str = "features") -> DataFrame:
    """Predict the label of each row's best unit; null where that unit has none."""
    placed = assign(rows, codebook, features)
    # ``labels`` has at most one row per neuron.
    return placed.join(
        small_side(labels.withColumnRenamed("unit_label", "prediction"), codebook.neurons), "bmu", "left"
    )
