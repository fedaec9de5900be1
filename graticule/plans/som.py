"""Batch self-organizing map: codebook, neighbourhood update, training loop.

Each iteration is one pass over the samples. Every task finds the best matching
unit of its rows and hands on only per-neuron counts and vector sums (at most
one row per neuron), so the data shuffled per iteration is bounded by
tasks x neurons, however many samples a neuron attracts. The neighbourhood is
applied afterwards to the per-neuron sums, which is the same sum reordered:
``sum_x h(bmu(x), j) x = sum_c h(c, j) sum_{bmu(x)=c} x``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.functions.dense import matrix, nearest, squared_distance, sums_by_group
from graticule.functions.hashing import unit_interval
from graticule.functions.schedules import decayed
from graticule.operators.sampling import PoissonDraw, sample_with_replacement
from graticule.session import check_model_size

# Wider vectors are merged element-wise as rows instead of as columns.
_WIDE = 32


@dataclass(frozen=True)
class Codebook:
    """Neuron weights on a rows x cols grid; neuron = row * cols + col."""

    rows: int
    cols: int
    weights: np.ndarray  # (rows * cols, width)

    def __post_init__(self) -> None:
        check_model_size(self.weights.size, "codebook")
        if self.weights.shape[0] != self.rows * self.cols:
            raise ValueError("one weight vector per grid cell is required")

    @property
    def width(self) -> int:
        return self.weights.shape[1]

    @property
    def neurons(self) -> int:
        return self.rows * self.cols

    @classmethod
    def random(cls, spark: SparkSession, rows: int, cols: int, width: int, seed: int = 0) -> Codebook:
        """Uniform [0, 1) weights that depend only on (seed, neuron, element)."""
        check_model_size(rows * cols * width, "codebook")
        cells = spark.range(rows * cols * width).select(
            unit_interval(F.expr(f"id div {width}"), F.expr(f"id % {width}"), seed=seed).alias("w"), "id"
        )
        table = cells.toPandas().sort_values("id")
        return cls(rows, cols, table["w"].to_numpy().reshape(rows * cols, width))

    @classmethod
    def from_table(cls, table: DataFrame, rows: int, cols: int) -> Codebook:
        """From rows (neuron, weights); the row count is bounded before collecting."""
        found = table.select("neuron", "weights").limit(rows * cols + 1).collect()
        if sorted(r["neuron"] for r in found) != list(range(rows * cols)):
            raise ValueError("the table must hold each neuron exactly once")
        found.sort(key=lambda r: r["neuron"])
        return cls(rows, cols, np.array([r["weights"] for r in found], dtype=np.float64))

    def to_table(self, spark: SparkSession) -> DataFrame:
        data = [(i, i // self.cols, i % self.cols, w) for i, w in enumerate(self.weights.tolist())]
        return spark.createDataFrame(data, "neuron int, row int, col int, weights array<double>")


def grid_distance(rows: int, cols: int) -> np.ndarray:
    """Squared grid distance between all pairs of neurons."""
    i = np.arange(rows * cols)
    r, c = i // cols, i % cols
    return (r[:, None] - r[None, :]) ** 2 + (c[:, None] - c[None, :]) ** 2


def neighbourhood(g: np.ndarray, sigma: float) -> np.ndarray:
    """exp(-g / 2 sigma^2) inside radius sigma, 0 outside."""
    s2 = sigma * sigma
    return np.where(g <= s2, np.exp(-g / (2 * s2)), 0.0)


def best_units(codebook: Codebook, features: Column | str = "features") -> Column:
    """Struct (bmu, second, d2): nearest and second nearest neuron, squared distance.

    A narrow Arrow projection: no shuffle, usable on batch and streaming frames.
    """
    w, width, k = codebook.weights, codebook.width, min(2, codebook.neurons)

    @F.arrow_udf("struct<bmu: int, second: int, d2: double>")
    def units(vectors: pa.Array) -> pa.Array:
        x = matrix(vectors, width)
        index = nearest(x, w, k)
        return pa.StructArray.from_arrays(
            [
                pa.array(index[:, 0], pa.int32()),
                pa.array(index[:, k - 1], pa.int32()),
                pa.array(squared_distance(x, w, index[:, 0]), pa.float64()),
            ],
            ["bmu", "second", "d2"],
        )

    return units(F.col(features) if isinstance(features, str) else features)


def assign(df: DataFrame, codebook: Codebook, features: str = "features") -> DataFrame:
    """Add ``bmu``, ``second`` and ``distance`` to every row."""
    return (
        df.withColumn("_unit", best_units(codebook, features))
        .withColumns(
            {"bmu": F.col("_unit.bmu"), "second": F.col("_unit.second"), "distance": F.sqrt(F.col("_unit.d2"))}
        )
        .drop("_unit")
    )


def unit_sums(
    samples: DataFrame, codebook: Codebook, features: str = "features", merge_groups: int | None = None
) -> DataFrame:
    """Rows (neuron, n, sums) of the neurons that won at least one sample.

    With very many input partitions pass ``merge_groups`` to merge the partials in
    two steps, so that one neuron's sums do not all meet in a single task.
    """
    w, width = codebook.weights, codebook.width

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(w), np.int64)
        sums = np.zeros_like(w)
        for batch in batches:
            x = matrix(batch.column(0), width)
            if len(x):
                ids, n, s = sums_by_group(x, nearest(x, w)[:, 0])
                counts[ids] += n
                sums[ids] += s
        won = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(won) + 1, dtype=np.int32) * width), pa.array(sums[won].ravel())
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(won, pa.int32()), pa.array(counts[won]), lists], ["neuron", "n", "sums"]
        )

    merged = samples.select(features).mapInArrow(partials, "neuron int, n bigint, sums array<double>")
    if merge_groups:
        step = merged.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(merge_groups)))
        merged = _merge(step, ["neuron", "_part"], width)
    return _merge(merged, ["neuron"], width)


def samples_of_maps(
    samples: DataFrame, books: Sequence[Codebook], copies: Sequence[Column | PoissonDraw] | None, features: str
) -> tuple[DataFrame, Callable]:
    """Rows for a pass over the samples of several maps, and what makes ``(x, [(rows drawn, copies) of each map])`` of a batch of them.

    Draws of one key and seed cross to Python once.
    """
    width = books[0].width
    if any(b.width != width for b in books) or (copies is not None and len(copies) != len(books)):
        raise ValueError("maps trained together need one width, and one column of copies each")
    check_model_size(sum(b.weights.size for b in books), "codebooks")
    columns: dict = {}
    for m, c in enumerate(copies or []):
        columns |= c.draws() if isinstance(c, PoissonDraw) else {m: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))}
    place = {name: i + 1 for i, name in enumerate(columns)}
    counted = [
        (c.copies if isinstance(c, PoissonDraw) else lambda drawn: drawn[0], [place[n] for n in (c.draws() if isinstance(c, PoissonDraw) else [m])])
        for m, c in enumerate(copies or [])
    ]

    def drawn(batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        x = matrix(batch.column(0), width)
        if not counted:
            return x, [(np.arange(len(x)), np.ones(len(x), np.int64))] * len(books)
        times = [count([batch.column(i).to_numpy() for i in at]) for count, at in counted]
        return x, [(rows := np.flatnonzero(t > 0), t[rows]) for t in times]

    return samples.select(F.col(features), *[c.alias(f"_draw{i}") for i, c in enumerate(columns.values())]), drawn


def unit_sums_of_maps(
    samples: DataFrame, books: Sequence[Codebook], copies: Sequence[Column | PoissonDraw] | None = None, features: str = "features",
    merge_groups: int | None = None,
) -> DataFrame:
    """Rows (map, neuron, n, sums) of several maps, numbered from 0, from one reading of ``samples``.

    ``copies[m]`` says how often map ``m`` draws a row (null: not at all); without it every map reads
    every row once. Maps may differ in their grids, not in their width.
    """
    rows, drawn_of = samples_of_maps(samples, books, copies, features)
    weights, width = [b.weights for b in books], books[0].width

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(w), np.int64) for w in weights]
        sums = [np.zeros_like(w) for w in weights]
        for batch in batches:
            x, samples = drawn_of(batch)
            for m, (w, (drawn, again)) in enumerate(zip(weights, samples)):
                if len(drawn):
                    own = x[drawn]
                    ids, n, s = sums_by_group(np.repeat(own, again, axis=0), np.repeat(nearest(own, w)[:, 0], again))
                    counts[m][ids] += n
                    sums[m][ids] += s
        for m, (n, s) in enumerate(zip(counts, sums)):
            won = np.flatnonzero(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(won) + 1, dtype=np.int32) * width), pa.array(s[won].ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(won), m), pa.int32()), pa.array(won, pa.int32()), pa.array(n[won]), lists], ["map", "neuron", "n", "sums"]
            )

    merged = rows.mapInArrow(partials, "map int, neuron int, n bigint, sums array<double>")
    if merge_groups:
        step = merged.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(merge_groups)))
        merged = _merge(step, ["map", "neuron", "_part"], width)
    return _merge(merged, ["map", "neuron"], width)


def _merge(partials: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    if width <= _WIDE:
        sums = ", ".join(f"sum(sums[{i}])" for i in range(width))
        return partials.groupBy(*keys).agg(F.expr("sum(n) as n"), F.expr(f"array({sums}) as sums"))
    cells = partials.selectExpr(*keys, "n", "posexplode_outer(sums) as (k, s)")
    cells = cells.groupBy(*keys, "k").agg(F.expr("sum(n) as n"), F.expr("sum(s) as s"))
    # One list element per vector dimension of one neuron: bounded by the width.
    joined = "transform(array_sort(collect_list(struct(k, s))), e -> e.s) as sums"
    return cells.groupBy(*keys).agg(F.expr("max(n) as n"), F.expr(joined))


def updated(codebook: Codebook, stats: Sequence, sigma: float, digits: int | None = 12) -> Codebook:
    """New weights from per-neuron (neuron, n, sums) rows; untouched neurons keep theirs.

    The neighbourhood is walked offset by offset, so memory follows the number of
    neurons, not its square. With ``digits`` (None: off) weights keep so many digits after the
    first: neurons whose weights agree in exact arithmetic then agree in fact, and ties
    between them go to the lowest neuron instead of following the order in which
    partial sums arrived.
    """
    counts = np.zeros(codebook.neurons)
    sums = np.zeros_like(codebook.weights)
    for r in stats:
        counts[r["neuron"]] = r["n"]
        sums[r["neuron"]] = r["sums"]
    shape = (codebook.rows, codebook.cols)
    counts, sums = counts.reshape(shape), sums.reshape(*shape, -1)
    den, num = np.zeros(shape), np.zeros_like(sums)
    for dr, dc, h in offsets(*shape, sigma):
        to, source = zip(_overlap(dr, shape[0]), _overlap(dc, shape[1]))
        den[to] += h * counts[source]
        num[to] += h * sums[source]
    den, num = den.ravel(), num.reshape(codebook.neurons, -1)
    target = np.divide(num, den[:, None], out=codebook.weights.copy(), where=den[:, None] > 0)
    return Codebook(codebook.rows, codebook.cols, target if digits is None else _significant(target, digits))


def offsets(rows: int, cols: int, sigma: float) -> list[tuple[int, int, float]]:
    """Grid steps inside radius sigma with their neighbourhood value."""
    reach = int(min(sigma, max(rows, cols)))
    steps = [(dr, dc, dr * dr + dc * dc) for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1)]
    return [(dr, dc, math.exp(-g / (2 * sigma * sigma))) for dr, dc, g in steps if g <= sigma * sigma and abs(dr) < rows and abs(dc) < cols]


def _overlap(step: int, size: int) -> tuple[slice, slice]:
    """Where cells moved by ``step`` land, and where they come from."""
    return slice(max(0, step), size + min(0, step)), slice(max(0, -step), size - max(0, step))


def _significant(x: np.ndarray, digits: int) -> np.ndarray:
    size = np.abs(x)
    scale = 10.0 ** np.floor(np.log10(size, out=np.zeros_like(x), where=size > 0))
    return np.round(x / scale, digits) * scale


def update_table(stats: DataFrame, grid: DataFrame, sigma: float) -> DataFrame:
    """The same update as a join of per-neuron sums with the grid, for inspection in SQL.

    ``grid`` holds (neuron, row, col, weights). Both sides have at most one row per neuron.
    """
    s2, reach = sigma * sigma, int(sigma)
    near = [(dr, dc) for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1) if dr * dr + dc * dc <= s2]
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in near]))
    # Only cells inside the radius are made, and they meet the grid by row and column.
    won = stats.join(grid.select("neuron", "row", "col"), "neuron").select("row", "col", "n", "sums", steps.alias("d"))
    g = F.col("d.dr") ** 2 + F.col("d.dc") ** 2
    won = won.select(
        (F.col("row") + F.col("d.dr")).alias("row"), (F.col("col") + F.col("d.dc")).alias("col"), F.exp(-g / (2 * s2)).alias("h"), "n", "sums"
    )
    shares = won.select("row", "col", (F.col("h") * F.col("n")).alias("hn"), "h", F.posexplode("sums").alias("k", "s"))
    shares = shares.groupBy("row", "col", "k").agg(F.sum(F.col("h") * F.col("s")).alias("num"), F.sum("hn").alias("den"))
    cells = grid.select("neuron", "row", "col", F.posexplode("weights").alias("k", "w"))
    summed = cells.join(shares, ["row", "col", "k"], "left")
    return summed.select(
        "neuron", "row", "col", "k", F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.col("w")).alias("w")
    )


def train_som(
    samples: DataFrame,
    rows: int,
    cols: int,
    iterations: int,
    width: int | None = None,
    smooth_iterations: int | None = None,
    sigma_0: float = 10.0,
    sigma_f: float = 0.1,
    tau: float = 400.0,
    seed: int = 0,
    init: Codebook | None = None,
    features: str = "features",
    subset_fraction: float | None = None,
    key: Sequence | None = None,
    merge_groups: int | None = None,
    digits: int | None = 12,
) -> Codebook:
    """Train a map; one Spark action per iteration.

    With ``subset_fraction`` each iteration draws a fresh sample with replacement
    by ``key``, which must tell rows apart. ``digits`` rounds weights in every iteration (see
    ``updated``). Persist ``samples`` beforehand when they fit in cluster memory.
    """
    if subset_fraction is not None and not key:
        raise ValueError("subset_fraction needs a key: equal vectors would share one draw")
    if init is None:
        if width is None:
            width = len(samples.select(features).first()[0])
        init = Codebook.random(samples.sparkSession, rows, cols, width, seed)
    codebook = init
    for t in range(iterations):
        sigma = decayed(t, sigma_0, sigma_f, tau, smooth_iterations)
        drawn = samples
        if subset_fraction is not None:
            drawn = sample_with_replacement(samples, key, subset_fraction, seed + t)
        codebook = updated(codebook, unit_sums(drawn, codebook, features, merge_groups).collect(), sigma, digits)
    return codebook


def train_soms(
    samples: DataFrame,
    books: Sequence[Codebook],
    iterations: int,
    copies: Sequence[Column | PoissonDraw] | None = None,
    smooth_iterations: int | None = None,
    sigma_0: float = 10.0,
    sigma_f: float = 0.1,
    tau: float = 400.0,
    features: str = "features",
    merge_groups: int | None = None,
    digits: int | None = 12,
) -> list[Codebook]:
    """Train several maps together; one Spark action and one reading of ``samples`` per iteration for all.

    ``books`` are the initial maps (seeds, grids), ``copies`` how often each draws a row, such as
    ``PoissonDraw`` of several fractions. Each map is what ``train_som`` gives for its sample.
    """
    books = list(books)
    for t in range(iterations if books else 0):
        sigma = decayed(t, sigma_0, sigma_f, tau, smooth_iterations)
        stats = unit_sums_of_maps(samples, books, copies, features, merge_groups).collect()
        books = [updated(b, [r for r in stats if r["map"] == m], sigma, digits) for m, b in enumerate(books)]
    return books
