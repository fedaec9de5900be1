"""Post-pruning by validation error.

Spark counts rows and positives per reached leaf (one narrow pass and one small
aggregate). Everything after that is arithmetic on the node table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.plans.tree import Node, TreeModel, stop_node


def leaf_counts(rows: DataFrame, model: TreeModel, label: str = "label", features: str = "features") -> DataFrame:
    """(tree_id, level, node, n, n_pos) of the leaves that rows reach."""
    ids = F.col("tree_id") if "tree_id" in rows.columns else F.lit(model.tree_ids[0])
    stopped = rows.select(stop_node(model, features, ids).alias("at"), F.col(label).cast("bigint").alias("y"))
    counted = stopped.where("at is not null").groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos")
    )
    index = rows.sparkSession.createDataFrame(
        [(i, r.tree_id, r.level, r.node) for i, r in enumerate(model.nodes)],
        "at int, tree_id int, level int, node bigint",
    )
    return counted.join(index, "at").select("tree_id", "level", "node", "n", "n_pos")


@dataclass
class _Branch:
    """A node with its validation counts and its current subtree's errors and leaves."""

    row: Node
    n: int = 0
    pos: int = 0
    errors: int = 0
    leaves: int = 1
    collapsed: bool = False

    @property
    def leaf_errors(self) -> int:
        return self.pos if self.row.label < 0.5 else self.n - self.pos

    @property
    def is_leaf(self) -> bool:
        return self.collapsed or not self.row.is_split


def _branches(model: TreeModel, counts: DataFrame) -> dict[tuple[int, int, int], _Branch]:
    """Counts per node: leaves as counted (at most one row per model node), splits summed up."""
    tree = {(r.tree_id, r.level, r.node): _Branch(r) for r in model.nodes}
    for c in counts.collect():
        b = tree[c["tree_id"], c["level"], c["node"]]
        b.n, b.pos = c["n"], c["n_pos"]
    for key in sorted(tree, key=lambda k: -k[1]):
        b = tree[key]
        if b.row.is_split:
            for child in _children(key):
                b.n += tree[child].n
                b.pos += tree[child].pos
    return tree


def _children(key: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    tree_id, level, node = key
    return [(tree_id, level + 1, 2 * node), (tree_id, level + 1, 2 * node + 1)]


def _settle(tree: dict, key: tuple[int, int, int]) -> None:
    b = tree[key]
    if b.is_leaf:
        b.errors, b.leaves = b.leaf_errors, 1
    else:
        below = [tree[c] for c in _children(key)]
        b.errors, b.leaves = sum(c.errors for c in below), sum(c.leaves for c in below)


def _remaining(tree: dict, model: TreeModel) -> TreeModel:
    out, hidden = [], set()
    for r in sorted(model.nodes, key=lambda r: (r.tree_id, r.level, r.node)):
        key = (r.tree_id, r.level, r.node)
        b = tree[key]
        if key in hidden or b.is_leaf:
            hidden.update(_children(key))
        if key not in hidden:
            out.append(r.as_leaf() if b.is_leaf else r)
    return TreeModel(out)


def reduced_error(model: TreeModel, counts: DataFrame) -> TreeModel:
    """Replace splits by majority leaves, bottom-up, while validation errors do not grow.

    A split is tried once both its children are leaves; a branch stops at the first
    split whose removal would add errors.
    """
    tree = _branches(model, counts)
    for key in sorted(tree, key=lambda k: -k[1]):
        _settle(tree, key)
        b = tree[key]
        if b.row.is_split and all(tree[c].is_leaf for c in _children(key)) and b.leaf_errors <= b.errors:
            b.collapsed = True
            _settle(tree, key)
    return _remaining(tree, model)


def cost_complexity(model: TreeModel, counts: DataFrame) -> tuple[TreeModel, list[tuple[int, int, int, float]]]:
    """The most accurate tree of the weakest-link sequence, per tree.

    Each step collapses the subtree with the smallest (added errors) / (removed
    leaves), ties to the lowest (level, node). Returns the best model and the
    sequence as (tree_id, leaves, errors, ratio) rows, the full tree first with
    ratio 0. Equal errors prefer the smaller tree.
    """
    steps, best_nodes = [], []
    by_tree: dict[int, dict] = {t: {} for t in model.tree_ids}
    for key, b in _branches(model, counts).items():
        by_tree[key[0]][key] = b
    rows: dict[int, list[Node]] = {t: [] for t in model.tree_ids}
    for r in model.nodes:
        rows[r.tree_id].append(r)
    for tree_id, tree in by_tree.items():
        taken = _weakest_links(tree)
        steps += [(tree_id, leaves, errors, ratio) for _, leaves, errors, ratio in taken]
        least = min(errors for _, _, errors, _ in taken)
        last = max(i for i, step in enumerate(taken) if step[2] == least)
        gone = {key for key, *_ in taken[1 : last + 1]}
        for key, b in tree.items():
            b.collapsed = key in gone
        best_nodes += _remaining(tree, TreeModel(rows[tree_id])).nodes
    return TreeModel(best_nodes), steps


def _weakest_links(tree: dict[tuple[int, int, int], _Branch]) -> list[tuple]:
    """``(collapsed split, leaves, errors, ratio)`` of every step, the full tree first.

    A heap holds the splits by ratio. A collapse changes only the path to the root, whose
    splits are entered anew; entries of gone or changed splits are dropped when they
    come up. That is n depth log n for n splits.
    """
    order = sorted(tree, key=lambda k: -k[1])
    for key in order:
        _settle(tree, key)
    root = order[-1]
    steps = [(None, tree[root].leaves, tree[root].errors, 0.0)]
    live = {k for k in order if tree[k].row.is_split}

    def entry(k: tuple[int, int, int]) -> tuple:
        b = tree[k]
        return (b.leaf_errors - b.errors) / (b.leaves - 1), k[1], k[2], k

    newest = {k: entry(k) for k in live}
    heap = list(newest.values())
    heapq.heapify(heap)
    while live:
        ratio, _, _, key = found = heapq.heappop(heap)
        if key not in live or newest[key] != found:
            continue
        tree[key].collapsed = True
        below = [key]
        while below:  # every split is taken out once
            k = below.pop()
            if k in live:
                live.discard(k)
                below += _children(k)
        up = key
        while True:
            _settle(tree, up)
            if up in live:
                newest[up] = entry(up)
                heapq.heappush(heap, newest[up])
            if up == root:
                break
            up = (up[0], up[1] - 1, up[2] // 2)
        steps.append((key, tree[root].leaves, tree[root].errors, ratio))
    return steps
