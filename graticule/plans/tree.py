"""Exact binary decision trees, grown level by level for all trees at once.

A tree is a *key*, not a task: the passes of one level serve every node of every
tree, so a forest, a cross-validation or a grid of runs is one training call
over rows with different ``tree_id`` values, or with an array of them. Each pass
sends the rows down the splits chosen so far, which are a small model held by the
driver, and shuffles only aggregates. Once half of the rows stand in finished nodes, the
others are written to the shared folder with the nodes they have come to, so that
all passes together read each row a bounded number of times beyond its own depth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.functions.dense import FlatTrees, matrix, members
from graticule.functions.impurity import gain
from graticule.operators.scans import range_edges, running_sums
from graticule.operators.splits import Level, boundary_splits, bounded_splits, lines_together, outright_splits
from graticule.session import BROADCAST_ROWS, check_model_size, small_side, written

# Nodes up to this many rows are searched outright.
OUTRIGHT_ROWS = 200_000
# Larger nodes get value ranges of about this many rows, up to MAX_RANGES.
ROWS_PER_RANGE = 12_500
MAX_RANGES = 1 << 14

NODE_SCHEMA = (
    "tree_id int, level int, node bigint, is_split boolean, feature int, threshold double, "
    "label double, n bigint, s double, criterion double"
)


class Node(NamedTuple):
    """One row of the tree table; ``s`` is the target sum (positives of a 0/1 label)."""

    tree_id: int
    level: int
    node: int
    is_split: bool
    feature: int | None
    threshold: float | None
    label: float
    n: int
    s: float
    criterion: float | None

    def as_leaf(self) -> Node:
        return self._replace(is_split=False, feature=None, threshold=None, criterion=None)


@dataclass
class TreeModel:
    """Nodes of one or more trees; children of node i are 2i and 2i + 1 one level down."""

    nodes: list[Node] = field(default_factory=list)

    def __post_init__(self) -> None:
        check_model_size(len(self.nodes) * len(Node._fields), "tree table")

    @property
    def tree_ids(self) -> list[int]:
        return sorted({r.tree_id for r in self.nodes})

    @property
    def depth(self) -> int:
        return 1 + max((r.level for r in self.nodes), default=-1)

    def truncated(self, max_depth: int) -> TreeModel:
        """The trees the same rows give with fewer levels: cut splits become majority leaves."""
        kept = [r.as_leaf() if r.level == max_depth - 1 else r for r in self.nodes if r.level < max_depth]
        return TreeModel(kept)

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame) -> TreeModel:
        names = list(Node._fields)
        check_model_size(table.count() * len(names), "tree table")
        return cls([Node(*r) for r in table.select(*names).collect()])


def train_trees(
    rows: DataFrame,
    max_depth: int = 6,
    min_samples: int = 1,
    impurity: str = "gini",
    min_gain: float | None = None,
    search: str = "exact",
    edges: Sequence[Sequence[float]] | None = None,
    label: str = "label",
    features: str = "features",
    keep_rows: bool = True,
    outright_rows: int | None = None,
) -> TreeModel:
    """Grow one tree per ``tree_id`` (a single tree when the column is absent).

    An array column ``tree_ids`` lets a row train several trees; it is read and sent to Python once for all of them.
    ``max_depth`` counts levels including leaves. ``search`` is ``exact`` or
    ``histogram`` (only cuts at value-range boundaries, from ``edges`` per feature
    or at exact quantile ranks of each feature over all rows).
    Nodes above ``outright_rows`` (``OUTRIGHT_ROWS``) rows are searched in two passes, with equal results. ``impurity='variance'`` grows regression trees.
    ``keep_rows=False`` reads the source again in every pass instead of persisting it.
    """
    if search not in ("exact", "histogram"):
        raise ValueError("search must be 'exact' or 'histogram'")
    if "tree_ids" in rows.columns:
        at = F.col("tree_ids").cast("array<int>")
    else:
        at = F.array(F.col("tree_id").cast("int") if "tree_id" in rows.columns else F.lit(0))
    rows = rows.select(
        at.alias("at"),
        F.col(features).cast("array<double>").alias("features"),
        F.col(label).cast("double").alias("y"),
    )
    options = (max_depth, min_samples, impurity, min_gain, search, edges, OUTRIGHT_ROWS if outright_rows is None else outright_rows)
    if not keep_rows:
        return _grow(rows, *options)
    rows = rows.persist()
    try:
        return _grow(rows, *options)
    finally:
        rows.unpersist()


def _grow(
    rows: DataFrame, max_depth: int, min_samples: int, impurity: str, min_gain: float | None, search: str,
    edges: Sequence[Sequence[float]] | None, outright_rows: int,
) -> TreeModel:
    spark = rows.sparkSession
    # Rows of the same trees are added up first, then once for each of them.
    light = rows.groupBy("at").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("y").alias("labelled"),
        F.sum("y").alias("s"),
        F.max(F.size("features")).alias("width"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
    )
    totals = light.withColumn("tree_id", F.explode("at")).groupBy("tree_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "labelled", "s")], F.max("width").alias("width"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max")
    ).collect()
    if not totals:
        return TreeModel()
    if any(t["labelled"] < t["n"] for t in totals):
        raise ValueError("every training row needs a label")
    width = max(t["width"] for t in totals)
    y_min, y_max = min(t["y_min"] for t in totals), max(t["y_max"] for t in totals)
    if impurity != "variance" and (y_min < 0 or y_max > 1):
        raise ValueError("labels must be 0 or 1")

    bits, cuts = 0, [np.empty(0)] * width
    if edges is None and (search == "histogram" or max(t["n"] for t in totals) > outright_rows):
        count = sum(t["n"] for t in totals)
        bits = min(int(math.log2(MAX_RANGES)), max(5, math.ceil(math.log2(count / ROWS_PER_RANGE))))
        if search == "histogram":
            edges = rank_edges(rows, width, 1 << bits)
        else:
            names = [f"f{i}" for i in range(width)]
            wide = rows.select(*[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)])
            edges = range_edges(wide, names, 1 << bits, count)
    if edges is not None:
        cuts = [np.array(e, np.float64) for e in edges]
        bits = max(1, math.ceil(math.log2(max(len(e) for e in cuts) + 1)))

    def shift_of(n: int) -> int:
        if search == "histogram":
            return 0
        if n <= outright_rows:
            return bits
        return max(0, bits - int(math.log2(n / ROWS_PER_RANGE)))

    def leaf(tree_id: int, level: int, node: int, n: int, s: float) -> Node:
        value = s / n if impurity == "variance" else float(2 * s > n)
        return Node(tree_id, level, node, False, None, None, value, n, s, None)

    active = {(t["tree_id"], 0): (t["n"], t["s"]) for t in totals}
    nodes: list[Node] = []
    # Rows times trees that the table of rows holds; rewritten without its finished rows once half are finished.
    held, placed = sum(t["n"] for t in totals), False
    for level in range(max_depth):
        # Every active node starts as a leaf and becomes a split if a cut is found.
        first = len(nodes)
        nodes += [leaf(t, level, i, n, s) for (t, i), (n, s) in sorted(active.items())]
        check_model_size(len(nodes) * len(Node._fields), "tree table")
        if level == max_depth - 1:
            break
        is_open = [
            j
            for j in range(first, len(nodes))
            if nodes[j].n > max(min_samples, 1) and (impurity == "variance" or nodes[j].s not in (0, nodes[j].n))
        ]
        if not is_open:
            break
        slot = np.full(len(nodes), -1, np.int64)
        slot[is_open] = np.arange(len(is_open))
        shift = np.array([shift_of(nodes[j].n) for j in is_open], np.int64)
        trees, places = (np.array([nodes[j][c] for j in is_open], np.int64) for c in (0, 2))
        here = Level(FlatTrees(nodes), slot, shift, cuts, width, bits, placed, lines_together(trees, places, shift, bits))
        going = sum(nodes[j].n for j in is_open)
        if level and 2 * going <= held:
            rows, held, placed = written(_placed(rows, here), "tree-rows"), going, True
            here = replace(here, placed=True)
        n, s = np.array([nodes[j].n for j in is_open], np.int64), np.array([nodes[j].s for j in is_open], np.float64)
        known = pa.table({"slot": pa.array(range(len(is_open)), pa.int32()), "n": pa.array(n), "s": pa.array(s)})
        sums = small_side(spark.createDataFrame(known), len(is_open))
        if search == "histogram":
            found = boundary_splits(rows, here, sums, impurity, y_min, y_max)
        elif (shift == bits).all():
            found = outright_splits(rows, here, n, s, impurity)
        else:
            found = bounded_splits(rows, here, sums, n, s, impurity, y_min, y_max, BROADCAST_ROWS)
        active = {}
        for s, (score, feature, value, next_value, n_left, s_left) in sorted(found.items()):
            j = is_open[s]
            r = nodes[j]
            worth = gain(impurity, score, r.n, r.s)
            # A regression node whose split removes no variance is as good as pure.
            flat = impurity == "variance" and worth <= 1e-12 * max(1.0, (r.s / r.n) ** 2)
            if flat or (min_gain is not None and worth < min_gain):
                continue
            middle = between(value, next_value)
            nodes[j] = r._replace(is_split=True, feature=feature, threshold=middle, criterion=score)
            active[r.tree_id, 2 * r.node] = (n_left, s_left)
            active[r.tree_id, 2 * r.node + 1] = (r.n - n_left, r.s - s_left)
        if not active:
            break
    return TreeModel(nodes)


def _placed(rows: DataFrame, level: Level) -> DataFrame:
    """The rows of open nodes, each with the nodes it has come to: later passes go on from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), level.width)
            row, at = members(batch.column(0))
            stop = level.stops(x, row, at)
            keep = (stop >= 0) & (level.slot[stop] >= 0)
            sizes = np.bincount(row[keep], minlength=len(x))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(stop[keep], pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1), batch.column(2)], batch.schema.names).filter(pa.array(sizes > 0))

    return rows.mapInArrow(run, "at array<int>, features array<double>, y double")


def rank_edges(rows: DataFrame, width: int, ranges: int) -> list[list[float]]:
    """Inner edges at the values of ranks ``k n / ranges`` of each feature, and the value after one that fills a whole range.

    They are candidate thresholds, so they follow from all rows and nothing else. Values
    from an edge up to the next share a range: a heavy value is parted from both sides.
    """
    entries = rows.select(F.posexplode("features").alias("feature", "value")).where("value is not null and not isnan(value)")
    counts = entries.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c")).persist()
    try:
        upto = running_sums(counts, {"upto": "c"}, ["value"], ["feature"], totals={"n": "c"})
        crossed = upto.where(f"least(upto * {ranges} div n, {ranges - 1}) > (upto - c) * {ranges} div n")
        at = [[] for _ in range(width)]
        for feature, value, heavy in crossed.selectExpr("feature", "value", f"c * {ranges} >= n").collect():  # below `ranges` a feature
            at[feature].append((value, heavy))
        edges = [np.array([v for v, _ in sorted(a)], np.float64) for a in at]
        heavy = [np.array([h for _, h in sorted(a)], bool) for a in at]
        if not any(h.any() for h in heavy):
            return [e.tolist() for e in edges]

        def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                feature, value = (batch.column(c).to_numpy() for c in ("feature", "value"))
                for f in np.unique(feature):
                    if not len(edges[f]):
                        continue
                    v = np.sort(value[feature == f])
                    last = np.searchsorted(edges[f], v, side="right") - 1
                    keep = (last >= 0) & heavy[f][last] & (edges[f][last] < v)
                    v, (last, first) = v[keep], np.unique(last[keep], return_index=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(last), f), pa.int32()), pa.array(last, pa.int32()), pa.array(v[first], pa.float64())], ["feature", "edge", "value"]
                    )

        next_values = counts.select("feature", "value").mapInArrow(after, "feature int, edge int, value double")
        found = next_values.groupBy("feature", "edge").agg(F.min("value").alias("value")).collect()
    finally:
        counts.unpersist()
    extra = [[r["value"] for r in found if r["feature"] == f] for f in range(width)]
    return [sorted({*e.tolist(), *x}) for e, x in zip(edges, extra)]


def between(value: float, next_value: float) -> float:
    """Threshold that keeps ``value`` left and ``next_value`` right: their middle, or ``value`` where that rounds up to the next."""
    middle = (value + next_value) / 2
    return middle if value <= middle < next_value else value


def stop_node(model: TreeModel, features: Column | str = "features", tree_id: Column | str = "tree_id") -> Column:
    """Index into ``model.nodes`` of the leaf each row reaches in the tree ``tree_id`` names.

    A narrow Arrow projection; null when there is no such tree.
    """
    trees = FlatTrees(model.nodes)

    @F.arrow_udf("int")
    def stop(ids: pa.Array, vectors: pa.Array) -> pa.Array:
        width = len(vectors[0].as_py()) if len(vectors) else 0
        found = trees.descend(matrix(vectors, width), trees.start(ids.to_numpy(zero_copy_only=False)))
        return pa.array(found, pa.int32(), mask=found < 0)

    vector = F.col(features) if isinstance(features, str) else features
    ids = F.col(tree_id) if isinstance(tree_id, str) else tree_id
    return stop(ids.cast("int"), vector.cast("array<double>"))


def predict(rows: DataFrame, model: TreeModel, features: str = "features", output: str = "prediction") -> DataFrame:
    """Add each row's prediction by the tree its ``tree_id`` names (tree 0 without that column)."""
    labels = np.array([r.label for r in model.nodes])
    trees = FlatTrees(model.nodes)

    @F.arrow_udf("double")
    def label_of(ids: pa.Array, vectors: pa.Array) -> pa.Array:
        width = len(vectors[0].as_py()) if len(vectors) else 0
        found = trees.descend(matrix(vectors, width), trees.start(ids.to_numpy(zero_copy_only=False)))
        return pa.array(labels[found], pa.float64(), mask=found < 0)

    ids = F.col("tree_id").cast("int") if "tree_id" in rows.columns else F.lit(model.tree_ids[0])
    return rows.withColumn(output, label_of(ids, F.col(features).cast("array<double>")))


def tree_expression(model: TreeModel, tree_id: int, features: Column | str = "features") -> Column:
    """One tree as nested ``when`` expressions: no Python worker, for shallow trees."""
    at = {(r.level, r.node): r for r in model.nodes if r.tree_id == tree_id}
    vector = F.col(features) if isinstance(features, str) else features

    def build(level: int, node: int) -> Column:
        r = at[level, node]
        if not r.is_split:
            return F.lit(r.label)
        return F.when(vector[r.feature] <= F.lit(r.threshold), build(level + 1, 2 * node)).otherwise(
            build(level + 1, 2 * node + 1)
        )

    return build(0, 0)
